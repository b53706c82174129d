"""Where results go: workbooks and JSON."""
