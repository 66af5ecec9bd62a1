"""Sources: event logs, source filters, record transforms and offset handling."""
