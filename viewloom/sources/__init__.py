"""Reading and writing of resources: the resource table, NDJSON load and export."""
