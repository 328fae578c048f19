"""End-to-end plans (essays -> windows -> scores -> evaluation) and the query catalog."""
