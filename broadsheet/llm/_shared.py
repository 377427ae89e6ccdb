"""What these operators share with the rest of the library."""

from broadsheet.shared import before, checkpoint_root, components, join_skewed, settled, shared_path

__all__ = ["before", "checkpoint_root", "components", "join_skewed", "settled", "shared_path"]
