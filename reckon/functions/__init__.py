"""Column functions: keys, statuses, money, timestamps, text."""
