"""Multi-tenant ad-campaign analytics as Spark DataFrame operators.

Every operator is a plain function from DataFrames to a DataFrame. With
``tenant_id=None`` it answers for all tenants in one job and puts
``tenant_id`` first; with a tenant given it answers for that tenant alone.
"""

__version__ = "0.1.0"
