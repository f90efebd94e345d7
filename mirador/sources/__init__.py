from mirador.sources.tables import (
    read_csv,
    scan,
    stage,
    unit_spine,
    validate_schema,
    write_csv,
    write_table,
)

__all__ = ["read_csv", "scan", "stage", "unit_spine", "validate_schema", "write_csv", "write_table"]
