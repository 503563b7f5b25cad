"""Event-time versions on Structured Streaming.

Stateless operators of ``Seq`` (map, filter, flat_map) work on streaming tables as they are. Here are those that need
state: windows and groups with a watermark, distinct, overlap joins, latest values, throttling and window batches. A window is
emitted when the watermark passes its end, so the last windows of a stream stay open; batch flushes them.
"""

from .stateful import combine_latest, throttle_first, window_batch, with_latest_from
from .windowed import buffers, distinct, group_counts, latest_per_tick, overlap_join, run_available

__all__ = ["buffers", "combine_latest", "distinct", "group_counts", "latest_per_tick", "overlap_join", "run_available", "throttle_first", "window_batch", "with_latest_from"]
