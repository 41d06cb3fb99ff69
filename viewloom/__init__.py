"""viewloom: FHIR ViewDefinitions compiled to Spark DataFrame plans."""
