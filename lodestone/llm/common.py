"""What the corpus operators share with the rest: durable intermediate tables,
size-checked broadcasts and connected components."""

from lodestone.operators.storage import BROADCAST_ROWS, components, discard, if_small, release, shared_dir, temporary, union, written

__all__ = ["BROADCAST_ROWS", "components", "discard", "if_small", "release", "shared_dir", "temporary", "union", "written"]
