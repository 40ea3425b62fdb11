"""Registry-analytics building blocks: functions."""
