"""Reading raw tables and reading / writing cube collections."""

from .cubes import assert_unique, duplicate_keys, flatten_id, nest_id, read_cube, write_cube
from .tables import TABLES, read_table

__all__ = ["assert_unique", "duplicate_keys", "flatten_id", "nest_id", "read_cube", "write_cube",
           "TABLES", "read_table"]
