"""The work database as tables: a SQLite file, read in ranges of its row numbers, with filters pushed to it."""

from __future__ import annotations

import sqlite3
from collections.abc import Iterator
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, EqualTo, Filter, GreaterThan, GreaterThanOrEqual, In, InputPartition, IsNotNull, IsNull, LessThan, LessThanOrEqual
from pyspark.sql.types import StructType

#: The tables and columns of the database, with the types that they are read as. Flags are whole numbers there.
TABLES = {
    "users": "username string, role string, display_name string, phone string, is_active boolean, created_at timestamp, updated_at timestamp, last_login_at timestamp",
    "tasks": """task_id string, name string, status string, deleted boolean, publisher string, manager string, product_tag string, part_prefix string, annotation_tool string,
        application_date string, applicant string, project string, annotation_content string, dataset_source string, hourly_capacity string, data_amount string, estimated_hours string,
        data_path string, guide_path string, expected_part_seconds double, priority string, rank bigint, created_at timestamp, updated_at timestamp""",
    "parts": """part_id bigint, task_id string, part_index bigint, name string, instructions string, work_path string, image_count bigint, bbox_count bigint, progress_count bigint,
        status string, annotator string, claimed_at timestamp, submitted_at timestamp, reviewed_at timestamp, work_seconds double, work_seconds_override double, submission_note string,
        review_note string, time_review_status string, time_review_note string, time_review_actor string, time_reviewed_at timestamp, created_at timestamp, updated_at timestamp""",
    "part_work_sessions": "session_id bigint, part_id bigint, annotator string, started_at timestamp, ended_at timestamp, duration_seconds double, created_at timestamp",
    "part_submission_events": """event_id bigint, part_id bigint, task_id string, annotator string, submitted_at timestamp, progress_count bigint, credited_count bigint, event_kind string,
        task_name string, project string, annotation_content string, part_name string, created_at timestamp""",
    "part_comments": "comment_id bigint, part_id bigint, actor string, kind string, content string, created_at timestamp",
    "task_audit_logs": "audit_id bigint, task_id string, actor string, action string, field_name string, old_value string, new_value string, detail string, created_at timestamp",
    "attendance_settings": "id bigint, work_start string, work_end string, updated_at timestamp",
    "attendance_records": "attendance_id bigint, username string, work_date string, checked_in_at timestamp",
    "notification_settings": "id bigint, config string, updated_at timestamp",
    "reminder_config": "id bigint, config string",
    "task_reminder_rules": "rule_id string, config string",
    "reminder_events": "event_id string, event_type string, task_id string, payload string, status string, detail string, created_at timestamp",
    "automatic_report_runs": "work_date string, status string, detail string, updated_at timestamp",
    "notifications": "notification_id bigint, username string, task_id string, message string, created_at timestamp, read_at timestamp, report_date string",
    "daily_reports": "report_date string, generated_at timestamp, snapshot string",
}
_KINDS = {"string": str, "bigint": int, "double": float, "timestamp": str, "boolean": int}
_SIGNS = {EqualTo: "=", GreaterThan: ">", GreaterThanOrEqual: ">=", LessThan: "<", LessThanOrEqual: "<="}


def columns(table: str) -> dict[str, str]:
    return dict(c.split() for c in TABLES[table].replace("\n", " ").split(",") if c.strip())


@dataclass
class Rows(InputPartition):
    first: int
    last: int


class WorkReader(DataSourceReader):
    """A table's rows in ranges of the row number, ``rows`` of them each, about."""

    def __init__(self, options: dict):
        self.path, self.table, self.rows = options["path"], options["table"], int(options.get("rows", 200_000))
        self.columns = list(columns(self.table))
        self.where: list[tuple[str, list]] = []

    def _open(self) -> sqlite3.Connection:
        return sqlite3.connect(f"file:{self.path}?mode=ro", uri=True)

    def pushFilters(self, filters: list[Filter]) -> Iterator[Filter]:  # noqa: N802  Spark's name
        """Comparisons of numbers and texts with a value go to the database; the others are Spark's."""
        for f in filters:
            name = f.attribute[0] if len(getattr(f, "attribute", ())) == 1 else None
            if name in self.columns and isinstance(f, (IsNull, IsNotNull)):
                self.where.append((f"{name} is {'not ' * isinstance(f, IsNotNull)}null", []))
            elif name in self.columns and type(f) in _SIGNS and type(f.value) in (int, float, str):
                self.where.append((f"{name} {_SIGNS[type(f)]} ?", [f.value]))
            elif name in self.columns and isinstance(f, In) and f.value and all(type(v) in (int, float, str) for v in f.value):
                self.where.append((f"{name} in ({', '.join('?' * len(f.value))})", list(f.value)))
            else:
                yield f

    def partitions(self) -> list[Rows]:
        with self._open() as db:
            first, last = db.execute(f"select min(rowid), max(rowid) from {self.table}").fetchone()
        return [] if first is None else [Rows(k, min(k + self.rows - 1, last)) for k in range(first, last + 1, self.rows)]

    def read(self, partition: Rows) -> Iterator[tuple]:
        if partition is None:  # an empty table has no range
            return
        given, held = dict.fromkeys(self.columns), self._open()
        there = {r[1] for r in held.execute(f"pragma table_info({self.table})")}
        picked = ", ".join(c if c in there else f"null as {c}" for c in given)
        test = "".join(f" and {text}" for text, _ in self.where)
        values = [v for _, own in self.where for v in own]
        kinds = [_KINDS[k] for k in columns(self.table).values()]
        for row in held.execute(f"select {picked} from {self.table} where rowid between ? and ?{test}", [partition.first, partition.last, *values]):
            yield tuple(None if v is None else kind(v) for v, kind in zip(row, kinds, strict=True))
        held.close()


class WorkDatabase(DataSource):
    """Options: path of the database file, which all executors must reach; table; rows of a range."""

    @classmethod
    def name(cls) -> str:
        return "trackloom_workdb"

    def schema(self) -> str:
        plain = {"timestamp": "string", "boolean": "bigint"}
        return ", ".join(f"{c} {plain.get(k, k)}" for c, k in columns(self.options["table"]).items())

    def reader(self, schema: StructType) -> DataSourceReader:
        return WorkReader(self.options)


def load_workdb(spark: SparkSession, path: str, rows: int = 200_000) -> dict[str, DataFrame]:
    """The tables that a work database has, by name, with fixed types: times are moments (texts with a zone, or at the session's), flags are booleans. Secrets (password hashes, session tokens, robots) aren't read. A column that an older file lacks is null."""
    spark.dataSource.register(WorkDatabase)
    spark.conf.set("spark.sql.python.filterPushdown.enabled", "true")
    with sqlite3.connect(f"file:{path}?mode=ro", uri=True) as db:
        there = {r[0] for r in db.execute("select name from sqlite_master where type = 'table'")}
    out = {}
    for table in TABLES:
        if table in there:
            raw = spark.read.format(WorkDatabase.name()).option("table", table).option("rows", rows).load(path)
            typed = {"timestamp": lambda c: F.col(c).try_cast("timestamp"), "boolean": lambda c: F.col(c) != 0}
            out[table] = raw.select(*[typed.get(k, F.col)(c).alias(c) for c, k in columns(table).items()])
    return out
