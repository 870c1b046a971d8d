"""Where intermediate tables are kept, and what is small enough to broadcast."""

from quillspark.storage import BROADCAST_ROWS, free_name, shared_folder, small, written

__all__ = ["BROADCAST_ROWS", "free_name", "shared_folder", "small", "written"]
