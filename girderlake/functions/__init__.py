"""Column functions: text, dates, money, policies. None needs Python on the executors."""
