"""Sources and sinks: schemas, CSV scan, fixture views, month spine, catalog, table sink."""
