"""Sources and sinks: reading the logs, bridging the test tables, writing layers."""
