"""A topic log as a Spark data source: partitions, offsets, replay by offset ranges, and streams that resume (SRC-07, SRC-11).

A log is a folder of segments, topic=T/partition=P/<first offset>-<rows>.parquet. Rows of a segment have the offsets that
follow its first. Paths are those that pyarrow's file systems open: local, HDFS, S3, GCS.
"""

from __future__ import annotations

import json
import re
import uuid
from dataclasses import dataclass
from urllib.parse import quote, unquote

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.datasource import DataSource, DataSourceArrowWriter, DataSourceReader, DataSourceStreamReader, InputPartition, WriterCommitMessage

NAME = "topic_log"
DATA = ["time", "key", "value"]
SCHEMA = "topic string, partition int, offset long, time timestamp, key string, value string"
ROWS = 1_000_000  # of a read task at most
_SEGMENT = re.compile(r"topic=([^/]*)/partition=(\d+)/(\d+)-(\d+)\.parquet$")


def _open(path: str):
    from pyarrow import fs

    local = re.sub(r"^file:/+", "/", path)
    return fs.FileSystem.from_uri(path) if "://" in local else (fs.LocalFileSystem(), local)


@dataclass
class Segment(InputPartition):
    """Rows of one file: those from first, rows of them."""

    file: str
    topic: str
    partition: int
    base: int
    first: int
    rows: int


def segments(path: str) -> list[Segment]:
    """All segments of a log, in order; only names are read."""
    from pyarrow import fs

    store, root = _open(path)
    found = store.get_file_info(fs.FileSelector(root, allow_not_found=True, recursive=True))
    out = [Segment(f.path, unquote(m[1]), int(m[2]), int(m[3]), int(m[3]), int(m[4])) for f in found if (m := _SEGMENT.search(f.path))]
    return sorted(out, key=lambda s: (s.topic, s.partition, s.base))


def _ends(found: list[Segment]) -> dict[tuple[str, int], int]:
    return {(s.topic, s.partition): s.base + s.rows for s in found}


def _between(found: list[Segment], ranges: list[tuple[str, int, int, int]]) -> list[Segment]:
    """What lies in the ranges (topic, partition, first, past the last), each row once, in tasks of at most ROWS rows."""
    by: dict = {}
    for topic, partition, lo, hi in sorted(ranges):
        own = by.setdefault((topic, partition), [])
        if own and lo <= own[-1][1]:
            own[-1][1] = max(own[-1][1], hi)
        elif lo < hi:
            own.append([lo, hi])
    out = []
    for s in found:
        for lo, hi in by.get((s.topic, s.partition), []):
            lo, hi = max(lo, s.base), min(hi, s.base + s.rows)
            out += [Segment(s.file, s.topic, s.partition, s.base, at, min(ROWS, hi - at)) for at in range(lo, hi, ROWS)]
    return out


def _read(path: str, s: Segment | None):
    import pyarrow as pa
    import pyarrow.parquet as pq

    if s is None:  # a read of no segments
        return
    store, _ = _open(path)
    with store.open_input_file(s.file) as f:
        at = s.base
        for b in pq.ParquetFile(f).iter_batches(columns=DATA):
            lo, hi = max(s.first - at, 0), min(s.first + s.rows - at, len(b))
            if lo < hi:
                part, n = b.slice(lo, hi - lo), hi - lo
                yield pa.RecordBatch.from_arrays([pa.array([s.topic] * n, pa.string()), pa.array([s.partition] * n, pa.int32()), pa.array(range(at + lo, at + hi), pa.int64()), *(part.column(c) for c in DATA)], names=["topic", "partition", "offset", *DATA])
            at += len(b)
            if at >= s.first + s.rows:
                return


class LogReader(DataSourceReader):
    def __init__(self, path: str, ranges: list | None):
        self.path, self.ranges = path, ranges

    def partitions(self) -> list[Segment]:
        found = segments(self.path)
        return _between(found, self.ranges if self.ranges is not None else [(*k, 0, end) for k, end in _ends(found).items()])

    def read(self, partition: Segment):
        return _read(self.path, partition)


class LogStream(DataSourceStreamReader):
    """Offsets are {topic: {partition: next offset}}: the checkpoint's record of where a stream stands."""

    def __init__(self, path: str):
        self.path = path

    def initialOffset(self) -> dict:
        return {}

    def latestOffset(self) -> dict:
        out: dict = {}
        for (topic, partition), end in _ends(segments(self.path)).items():
            out.setdefault(topic, {})[str(partition)] = end
        return out

    def partitions(self, start: dict, end: dict) -> list[Segment]:
        return _between(segments(self.path), [(t, int(p), start.get(t, {}).get(p, 0), hi) for t, own in end.items() for p, hi in own.items()])

    def read(self, partition: Segment):
        return _read(self.path, partition)

    def commit(self, end: dict) -> None:
        pass


@dataclass
class Written(WriterCommitMessage):
    task: int
    files: list


class LogWriter(DataSourceArrowWriter):
    """Tasks write their rows by topic and partition to pending files; the driver then gives them the offsets that follow the
    log's last, in the order of the tasks. Rows of a task keep their order. One writer a log at a time."""

    def __init__(self, path: str):
        self.path, self.run = path, uuid.uuid4().hex

    def write(self, iterator):
        import pyarrow as pa
        import pyarrow.compute as pc
        import pyarrow.parquet as pq
        from pyspark import TaskContext

        store, root = _open(self.path)
        task, open_, counts = TaskContext.get(), {}, {}
        folder = f"{root}/_pending/{self.run}"
        store.create_dir(folder, recursive=True)
        for b in iterator:
            t = pa.Table.from_batches([b])
            for group in t.group_by(["topic", "partition"]).aggregate([]).to_pylist():
                key = (group["topic"], group["partition"])
                own = t.filter(pc.and_(pc.equal(t["topic"], key[0]), pc.equal(t["partition"], key[1]))).select(DATA)
                if key not in open_:
                    file = f"{folder}/{task.partitionId()}-{task.taskAttemptId()}-{len(open_)}"
                    sink = store.open_output_stream(file)
                    open_[key] = (file, sink, pq.ParquetWriter(sink, own.schema))
                open_[key][2].write_table(own)
                counts[key] = counts.get(key, 0) + len(own)
        for _, sink, w in open_.values():
            w.close()
            sink.close()
        return Written(task.partitionId(), [(*key, file, counts[key]) for key, (file, _, _) in open_.items()])

    def commit(self, messages) -> None:
        store, root = _open(self.path)
        ends = _ends(segments(self.path))
        for m in sorted((m for m in messages if m is not None), key=lambda m: m.task):
            for topic, partition, file, n in m.files:
                at = ends.get((topic, partition), 0)
                folder = f"{root}/topic={quote(topic, safe='')}/partition={partition}"
                store.create_dir(folder, recursive=True)
                store.move(file, f"{folder}/{at:020d}-{n}.parquet")
                ends[topic, partition] = at + n
        self.abort(messages)

    def abort(self, messages) -> None:
        store, root = _open(self.path)
        store.delete_dir_contents(f"{root}/_pending/{self.run}", missing_dir_ok=True)


class TopicLog(DataSource):
    """format("topic_log"): option path, and for a batch read ranges, JSON of [[topic, partition, first, past the last], ..]."""

    @classmethod
    def name(cls) -> str:
        return NAME

    def schema(self) -> str:
        return SCHEMA

    def reader(self, schema) -> LogReader:
        ranges = self.options.get("ranges")
        return LogReader(self.options["path"], [tuple(r) for r in json.loads(ranges)] if ranges else None)

    def streamReader(self, schema) -> LogStream:
        return LogStream(self.options["path"])

    def writer(self, schema, overwrite: bool) -> LogWriter:
        if overwrite:
            raise ValueError("a log is appended to")
        return LogWriter(self.options["path"])


def _source(spark: SparkSession) -> str:
    spark.dataSource.register(TopicLog)
    return NAME


def append_log(rows: DataFrame, path: str) -> None:
    """rows(topic, partition, time, key, value) at the end of the log, each partition in order of time and key."""
    ordered = rows.select("topic", "partition", *DATA).repartition("topic", "partition").sortWithinPartitions("topic", "partition", "time", "key")
    ordered.write.format(_source(rows.sparkSession)).option("path", path).mode("append").save()


def read_log(spark: SparkSession, path: str) -> DataFrame:
    """All rows of the log, with their topic, partition and offset."""
    return spark.read.format(_source(spark)).option("path", path).load()


def read_log_stream(spark: SparkSession, path: str) -> DataFrame:
    """SRC-07. The log as a stream, from its first row or from where the stream's checkpoint stands."""
    return spark.readStream.format(_source(spark)).option("path", path).load()


def replay_log(spark: SparkSession, path: str, ranges: list[tuple[str, int, int, int]]) -> DataFrame:
    """SRC-11. The rows of offset ranges (topic, partition, first, past the last), each once; only the segments that hold them are read."""
    return spark.read.format(_source(spark)).option("path", path).option("ranges", json.dumps(ranges)).load()
