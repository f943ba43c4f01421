"""Operators: functions from DataFrame to DataFrame that run no job themselves."""
