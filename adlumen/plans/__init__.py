"""The driver's tables as campaign data, the registered queries and their SQL."""
