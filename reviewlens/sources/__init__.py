"""Sources and sinks: review files, API payloads, HTML pages."""
