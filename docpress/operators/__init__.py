"""DataFrame operators over rows, documents and collections."""

from docpress.operators.documents import (
    batch_documents, classify_frames, frame_documents, split_rejects, stamp, tag_batch,
    unpack)
from docpress.operators.gates import check, enforce
from docpress.operators.layout import (
    choose_partitions, partitions_for_bytes, read_by_id, read_spread, spread,
    write_by_id_hash, write_by_metric)
from docpress.operators.publish import (
    publish_frames, publish_options, publish_ordered, with_positions, write_frames)
from docpress.operators.ranked import metric_range, top_k
from docpress.operators.sinks import (
    append_documents, document_store_options, write_micro_batch)
from docpress.operators.stats import (
    batch_stats, collection_stats, ratio_count_summary, storage_stats)
from docpress.operators.unique import UniqueAppend, unique_append
from docpress.operators.windows import (
    documents_total, processing_rate, ratio_by_window, slide, time_buckets)

__all__ = [
    "UniqueAppend", "append_documents", "batch_documents", "batch_stats", "check",
    "choose_partitions", "classify_frames", "collection_stats", "document_store_options",
    "documents_total", "enforce", "frame_documents", "metric_range", "partitions_for_bytes",
    "processing_rate", "publish_frames", "publish_options", "publish_ordered", "ratio_by_window",
    "ratio_count_summary", "read_by_id", "read_spread", "slide", "split_rejects", "spread",
    "stamp", "storage_stats", "tag_batch", "time_buckets", "top_k", "unique_append", "unpack",
    "with_positions", "write_by_id_hash", "write_by_metric", "write_frames", "write_micro_batch",
]
