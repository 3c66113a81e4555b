from .fixtures import AS_OF, SESSION_AS_OF, load_tables, shop_table
from .raw import read_raw

__all__ = ["AS_OF", "SESSION_AS_OF", "load_tables", "shop_table", "read_raw"]
