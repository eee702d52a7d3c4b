"""Command line: ``python -m docpress batch …`` or ``python -m docpress stream …``.

Submit with ``spark-submit``; executor sizes and credentials belong there.
"""

from __future__ import annotations

import argparse
import logging

from docpress.functions.codec import DEFAULT_LEVEL
from docpress.operators.gates import MIN_RATIO
from docpress.operators.sinks import FILE_FORMATS, insert_options
from docpress.plans.batch import run_batch
from docpress.plans.daily import checked_run
from docpress.plans.stream import run_stream
from docpress.session import build_session
from docpress.sources.messages import DEFAULT_SERVERS, DEFAULT_TOPIC
from docpress.streaming.ingest import TRIGGER_SECONDS


def parser() -> argparse.ArgumentParser:
    top = argparse.ArgumentParser(prog="docpress", description=__doc__.splitlines()[0])
    commands = top.add_subparsers(dest="command", required=True)

    batch = commands.add_parser("batch", help="compress a dataset into a collection")
    batch.add_argument("--input-path", required=True)
    batch.add_argument("--output-path", help="not needed by a store that takes its target as options")
    batch.add_argument("--output-format", default="parquet")
    batch.add_argument("--output-option", action="append", default=[], metavar="KEY=VALUE")
    batch.add_argument("--batch-size", type=int, default=1000,
                       help="documents per insert of a document store; files need none")
    batch.add_argument("--compression-level", type=int, default=DEFAULT_LEVEL)
    batch.add_argument("--partitions", type=int, help="default: follows the input's size")
    batch.add_argument("--max-records-per-file", type=int)
    batch.add_argument("--id-col", default="id")
    batch.add_argument("--unique-ids", action="store_true")
    batch.add_argument("--run-id", help="a run that is started again under its id replaces itself")
    batch.add_argument("--check", action="store_true", help="fail when the collection misses its gates")
    batch.add_argument("--min-ratio", type=float, default=MIN_RATIO)

    stream = commands.add_parser("stream", help="compress a topic into a collection")
    stream.add_argument("--output-path", help="not needed by a store that takes its target as options")
    stream.add_argument("--output-format", default="parquet")
    stream.add_argument("--output-option", action="append", default=[], metavar="KEY=VALUE")
    stream.add_argument("--batch-size", type=int, default=1000,
                        help="documents per insert of a document store; files need none")
    stream.add_argument("--compression-level", type=int, default=DEFAULT_LEVEL)
    stream.add_argument("--partitions", type=int, help="spread each micro-batch over so many tasks")
    stream.add_argument("--trigger-seconds", type=int, default=TRIGGER_SECONDS)
    stream.add_argument("--kafka-servers", default=DEFAULT_SERVERS)
    stream.add_argument("--topic", default=DEFAULT_TOPIC)
    stream.add_argument("--starting-offsets", default="earliest")
    stream.add_argument("--max-offsets-per-trigger", type=int, default=1_000_000)
    stream.add_argument("--min-partitions", type=int,
                        help="tasks that read the topic, where it has fewer partitions")
    stream.add_argument("--fail-on-data-loss", action=argparse.BooleanOptionalAction, default=True)
    stream.add_argument("--checkpoint-dir", required=True,
                        help="a folder that driver and executors share")
    return top


def output_options(args: argparse.Namespace) -> dict[str, str]:
    given = dict(option.split("=", 1) for option in args.output_option)
    if args.output_format in FILE_FORMATS:
        return given
    return {**insert_options(args.batch_size), **given}


def stream_options(args: argparse.Namespace) -> dict[str, object]:
    return {
        "kafka_servers": args.kafka_servers, "topic": args.topic,
        "source_options": {
            "starting_offsets": args.starting_offsets,
            "max_offsets_per_trigger": args.max_offsets_per_trigger,
            "min_partitions": args.min_partitions, "fail_on_data_loss": args.fail_on_data_loss,
        },
        "level": args.compression_level, "partitions": args.partitions,
        "trigger_seconds": args.trigger_seconds, "output_format": args.output_format,
        "output_options": output_options(args),
    }


def main(arguments: list[str] | None = None) -> None:
    args = parser().parse_args(arguments)
    logging.basicConfig(level=logging.INFO)
    spark = build_session(f"docpress-{args.command}", streaming=args.command == "stream")
    if args.command == "stream":
        run_stream(spark, args.output_path, args.checkpoint_dir, **stream_options(args)
                   ).awaitTermination()
        return
    options = {
        "compression_level": args.compression_level, "partitions": args.partitions,
        "max_records_per_file": args.max_records_per_file, "id_col": args.id_col,
        "unique_ids": args.unique_ids, "run_id": args.run_id, "output_format": args.output_format,
        "output_options": output_options(args),
    }
    if args.check:
        checked_run(spark, args.input_path, args.output_path, min_ratio=args.min_ratio, **options)
    else:
        logging.info("%s", run_batch(spark, args.input_path, args.output_path, **options)
                     .collection.first())


if __name__ == "__main__":
    main()
