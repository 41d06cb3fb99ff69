"""FHIR-shaped resources from the relational tables of the test data."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def _resources(rows: DataFrame, kind: str, number: str, *fields: Column) -> DataFrame:
    body = F.struct(F.lit(kind).alias("resourceType"), *fields)
    return rows.select(F.col(number).cast("long").alias("id"), F.lit(kind).alias("resource_type"), F.to_json(body).alias("json"))


def _text(column: str) -> Column:
    return F.col(column).cast("string")


def _money(column: str) -> Column:
    return F.col(column).cast("decimal(18,2)")


def patients(spark: SparkSession, sf_dir: str) -> DataFrame:
    """customer with nation and region."""
    c = _table(spark, sf_dir, "customer")
    n, r = _table(spark, sf_dir, "nation"), _table(spark, sf_dir, "region")
    rows = c.join(n, c["c_nationkey"] == n["n_nationkey"]).join(r, n["n_regionkey"] == r["r_regionkey"])
    key = F.col("c_custkey")
    official = F.struct(F.lit("official").alias("use"), F.col("c_name").alias("family"), F.array("c_mktsegment", "n_name").alias("given"))
    usual = F.struct(F.lit("usual").alias("use"), F.col("n_name").alias("family"), F.array("c_mktsegment").alias("given"))
    phone = F.struct(F.lit("phone").alias("system"), F.concat(F.lit("p"), key).alias("value"), F.lit(1).alias("rank"))
    email = F.struct(F.lit("email").alias("system"), F.concat(F.lit("e"), key).alias("value"), F.lit(2).alias("rank"))
    contact = F.struct(F.array(F.struct(F.lit("phone").alias("system"), F.concat(F.lit("c"), key).alias("value"))).alias("telecom"))
    nation = F.expr("named_struct('url', 'urn:nation', 'valueString', n_name, 'extension', cast(null as array<struct<url:string,valueInteger:int,valueString:string>>))")
    region = F.expr(
        "named_struct('url', 'urn:region', 'valueString', cast(null as string), 'extension', array("
        "named_struct('url', 'code', 'valueInteger', r_regionkey, 'valueString', cast(null as string)), "
        "named_struct('url', 'name', 'valueInteger', cast(null as int), 'valueString', r_name)))"
    )
    return _resources(
        rows, "Patient", "c_custkey",
        _text("c_custkey").alias("id"),
        (F.col("c_acctbal") > 0).alias("active"),
        F.when(key % 3 == 0, "male").when(key % 3 == 1, "female").alias("gender"),
        F.when(key % 3 == 0, "1970").when(key % 3 == 1, "1970-02").otherwise("1970-02-15").alias("birthDate"),
        F.when(key % 2 == 0, F.array(official, usual)).otherwise(F.array(official)).alias("name"),
        F.when(key % 10 == 0, None).when(key % 4 == 0, F.array(email)).otherwise(F.array(phone, email)).alias("telecom"),
        F.when(key % 3 == 0, F.array(contact)).alias("contact"),
        F.array(F.struct(F.lit("urn:cust").alias("system"), F.col("c_name").alias("value"))).alias("identifier"),
        F.array(nation, region).alias("extension"),
        F.when(key % 2 == 0, (key % 5).cast("int")).alias("multipleBirthInteger"),
        F.when(key % 2 == 1, key % 7 == 0).alias("deceasedBoolean"),
        _money("c_acctbal").alias("balance"),
        F.struct(F.concat(F.lit("Organization/"), F.col("c_nationkey")).alias("reference")).alias("managingOrganization"),
    )


def organizations(spark: SparkSession, sf_dir: str) -> DataFrame:
    """supplier with nation."""
    s, n = _table(spark, sf_dir, "supplier"), _table(spark, sf_dir, "nation")
    rows = s.join(n, s["s_nationkey"] == n["n_nationkey"])
    return _resources(
        rows, "Organization", "s_suppkey", _text("s_suppkey").alias("id"), F.col("s_name").alias("name"),
        F.array(F.struct(F.col("n_name").alias("city"), F.array("s_name", "n_name").alias("line"))).alias("address"),
        _money("s_acctbal").alias("balance"),
    )


def claims(spark: SparkSession, sf_dir: str) -> DataFrame:
    """orders with their lineitems; an order without any has no item."""
    o, li = _table(spark, sf_dir, "orders"), _table(spark, sf_dir, "lineitem")
    item = F.struct(
        F.col("l_linenumber").alias("sequence"), F.col("l_partkey").alias("part"), F.col("l_suppkey").alias("supp"),
        _money("l_quantity").alias("quantity"), _money("l_extendedprice").alias("price"),
        F.col("l_returnflag").alias("flag"), F.col("l_linestatus").alias("status"),
    )
    items = li.groupBy("l_orderkey").agg(F.array_sort(F.collect_list(item)).alias("items"))
    rows = o.join(items, o["o_orderkey"] == items["l_orderkey"], "left")
    shaped = F.transform(
        "items",
        lambda x: F.struct(
            x["sequence"].alias("sequence"),
            F.struct(F.array(F.struct(F.concat(F.lit("P"), x["part"]).alias("code")), F.struct(x["flag"].alias("code"))).alias("coding")).alias("productOrService"),
            F.struct(x["quantity"].alias("value")).alias("quantity"),
            F.struct(x["price"].alias("value"), F.lit("USD").alias("currency")).alias("net"),
            F.struct(F.concat(F.lit("Organization/"), x["supp"]).alias("reference")).alias("provider"),
            x["status"].alias("status"),
        ),
    )
    return _resources(
        rows, "Claim", "o_orderkey", _text("o_orderkey").alias("id"), F.col("o_orderstatus").alias("status"), F.col("o_orderpriority").alias("priority"),
        F.date_format("o_orderdate", "yyyy-MM-dd").alias("created"),
        F.struct(F.concat(F.lit("Patient/"), F.col("o_custkey")).alias("reference")).alias("patient"),
        F.struct(_money("o_totalprice").alias("value"), F.lit("USD").alias("currency")).alias("total"), shaped.alias("item"),
    )


def observations(spark: SparkSession, sf_dir: str) -> DataFrame:
    """events; value[x] is a quantity, a string or an integer."""
    e = _table(spark, sf_dir, "events")
    key, value = F.col("event_id"), F.col("value").cast("decimal(18,3)")
    part = F.struct(F.col("event_type").alias("code"), F.struct(value.alias("value")).alias("valueQuantity"))
    other = F.struct(F.lit("key").alias("code"), F.expr("cast(null as struct<value:decimal(18,3)>)").alias("valueQuantity"))
    return _resources(
        e, "Observation", "event_id", _text("event_id").alias("id"), F.lit("final").alias("status"),
        F.date_format("ts", "yyyy-MM-dd'T'HH:mm").alias("effectiveDateTime"),
        F.date_format("ts", "HH:mm:ss").alias("clock"),
        F.struct(F.array(F.struct(F.lit("urn:event").alias("system"), F.col("event_type").alias("code"))).alias("coding")).alias("code"),
        F.struct(F.concat(F.lit("Patient/"), F.col("user_id")).alias("reference")).alias("subject"),
        F.when(key % 3 == 0, F.struct(value.alias("value"), F.lit("u").alias("unit"))).alias("valueQuantity"),
        F.when(key % 3 == 1, F.col("event_type")).alias("valueString"),
        F.when(key % 3 == 2, F.col("user_id").cast("int")).alias("valueInteger"),
        F.when(key % 2 == 0, F.array(part, other)).alias("component"),
    )


def communications(spark: SparkSession, sf_dir: str) -> DataFrame:
    """conversations: a resource for each turn."""
    c = _table(spark, sf_dir, "conversations")
    c = c.withColumn("k", F.col("conv_id") * 1000 + F.col("turn"))
    return _resources(
        c, "Communication", "k", F.concat_ws("-", "conv_id", "turn").alias("id"), F.lit("completed").alias("status"),
        F.struct(F.concat(F.lit("Practitioner/"), F.col("role")).alias("reference")).alias("sender"),
        F.struct(F.concat(F.lit("Group/"), F.col("conv_id")).alias("reference")).alias("subject"),
        F.array(F.struct(F.col("text").alias("contentString"))).alias("payload"),
    )


def questionnaires(spark: SparkSession, sf_dir: str) -> DataFrame:
    """region: items are its nations, whose items are their suppliers."""
    r, n, s = (_table(spark, sf_dir, t) for t in ("region", "nation", "supplier"))
    leaf = F.struct(F.concat(F.lit("S"), F.col("s_suppkey")).alias("linkId"), F.col("s_name").alias("text"))
    leaves = s.groupBy("s_nationkey").agg(F.array_sort(F.collect_list(leaf)).alias("item"))
    nation = F.struct(F.concat(F.lit("N"), F.lpad(F.col("n_nationkey").cast("string"), 3, "0")).alias("linkId"), F.col("n_name").alias("text"), F.col("item"))
    nations = n.join(leaves, n["n_nationkey"] == leaves["s_nationkey"], "left").groupBy("n_regionkey").agg(F.array_sort(F.collect_list(nation)).alias("item"))
    # Few and large documents: dealt out one by one, since a document's rows are all made in one task.
    rows = r.join(nations, r["r_regionkey"] == nations["n_regionkey"], "left").repartition(spark.sparkContext.defaultParallelism)
    return _resources(rows, "Questionnaire", "r_regionkey", _text("r_regionkey").alias("id"), F.col("r_name").alias("title"), F.col("item"))


def document_references(spark: SparkSession, sf_dir: str) -> DataFrame:
    """documents with labels."""
    d, lb = _table(spark, sf_dir, "documents"), _table(spark, sf_dir, "labels")
    rows = d.join(lb.select(F.col("doc_id").alias("k"), "quality", "toxic"), d["doc_id"] == F.col("k"), "left")
    label = F.struct(F.col("quality").alias("quality"), F.col("toxic").alias("toxic"))
    return _resources(
        rows, "DocumentReference", "doc_id", _text("doc_id").alias("id"), F.lit("current").alias("status"), F.col("lang").alias("language"),
        F.struct(F.col("source").alias("display")).alias("custodian"), F.array(F.struct(F.struct(F.col("text").alias("data")).alias("attachment"))).alias("content"),
        F.when(F.col("k").isNotNull(), F.array(label)).alias("category"),
    )


BUILDERS: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "Patient": patients, "Organization": organizations, "Claim": claims, "Observation": observations,
    "Communication": communications, "Questionnaire": questionnaires, "DocumentReference": document_references,
}


def stored(table) -> Callable[[str], Callable[[SparkSession, str], DataFrame]]:
    """Resources of a kind from a ResourceTable, in place of those that BUILDERS make."""

    def builder(kind: str) -> Callable[[SparkSession, str], DataFrame]:
        return lambda spark, sf_dir: table.read().filter(F.col("resource_type") == kind)

    return builder
