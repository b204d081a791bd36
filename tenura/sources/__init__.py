from tenura.sources.tables import read_table, read_csv_with_schema, TELCO_SCHEMA
from tenura.sources.panels import account_panel, shipment_panel

__all__ = ["read_table", "read_csv_with_schema", "TELCO_SCHEMA", "account_panel", "shipment_panel"]
