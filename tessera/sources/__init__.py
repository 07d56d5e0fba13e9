"""Sources and sinks: workspaces, tables, tool outputs, reports."""
