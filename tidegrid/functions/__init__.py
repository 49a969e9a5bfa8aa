"""Column expressions: null rules, calendars, scalars, geometry."""
