"""Registry dumps (RPSL-like records in gzip or plain text) as a Spark data source, and their typed objects.

Records are parsed file by file, since the grammar needs ordered lines; every
file is a partition.  A registry's field names are data, so all six share one
projection.
"""

from __future__ import annotations

import io
from collections.abc import Iterable, Iterator
from dataclasses import dataclass, field

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

from orgweave.functions.text import asn_digits, changed_email, integer_range, latest_time, registry_of

RAW = "record_id bigint, file string, attributes map<string, array<string>>"


def parse_records(lines: Iterable[str], wanted: frozenset[str] = frozenset()) -> Iterator[dict[str, list[str]]]:
    """Records of an ordered line stream.

    A blank line ends a record, and so does the end of the file.  Lines that
    start with ``#`` or ``%`` are comments.  A line that starts with a blank or
    ``+``, or has no key, continues the value before it; before any key it is
    dropped.  Repeated keys append, except ``origin``, where the last counts.
    With ``wanted``, only records that have one of its keys are kept.
    """
    record: dict[str, list[str]] = {}
    last = ""
    for raw in [*lines, ""] if isinstance(lines, list) else _with_end(lines):
        line = raw.rstrip("\r\n")
        if line == "":
            if record and (not wanted or wanted & record.keys()):
                yield record
            record, last = {}, ""
            continue
        if line[0] in "#%" or not line.strip():
            continue
        key, colon, value = line.partition(":")
        if line[0].isalnum() and colon and not any(c.isspace() for c in key):
            last = key
            if key == "origin":
                record[key] = [value.strip()]
            else:
                record.setdefault(key, []).append(value.strip())
        elif last:
            record[last].append(line.lstrip("+").strip())


def _with_end(lines: Iterable[str]) -> Iterator[str]:
    yield from lines
    yield ""


class _File(InputPartition):
    def __init__(self, path: str):
        super().__init__(path)
        self.path = path


def _store(path: str):
    """(file system, path on it) of a plain path or a URI (file, hdfs, s3 and so on), the same on driver and executors."""
    from pyarrow import fs

    return fs.FileSystem.from_uri(path) if "://" in path or path.startswith("file:") else (fs.LocalFileSystem(), path)


class _Reader(DataSourceReader):
    def __init__(self, path: str, wanted: frozenset[str]):
        self.path, self.wanted = path, wanted

    def partitions(self) -> list[InputPartition]:
        from pyarrow import fs

        store, at = _store(self.path)
        info = store.get_file_info(at)
        found = store.get_file_info(fs.FileSelector(at)) if info.type == fs.FileType.Directory else [info]
        return [_File(f) for f in sorted(i.path for i in found if i.type == fs.FileType.File)]

    def read(self, partition: InputPartition) -> Iterator[tuple]:
        store = _store(self.path)[0]
        with store.open_input_stream(partition.path, compression="gzip" if partition.path.endswith(".gz") else None) as raw:
            lines = io.TextIOWrapper(raw, encoding="latin-1")
            for at, record in enumerate(parse_records(lines, self.wanted)):
                yield at, partition.path, record


class RegistryDump(DataSource):
    """``spark.read.format("registry_dump").option("keys", "aut-num,organisation").load(path)``."""

    @classmethod
    def name(cls) -> str:
        return "registry_dump"

    def schema(self) -> str:
        return RAW

    def reader(self, schema: object) -> DataSourceReader:
        keys = frozenset(k for k in self.options.get("keys", "").split(",") if k)
        return _Reader(self.options["path"], keys)


@dataclass(frozen=True)
class Registry:
    """Field names of one registry; lists are read in order and joined."""

    name: str
    asn_class: str
    org_class: str | None
    contact_classes: tuple[str, ...]
    block_class: str | None
    time_field: str
    time_pattern: str
    time_word: int = 1
    time_joined: bool = True
    asn_fields: dict[str, list[str]] = field(default_factory=dict)
    org_fields: dict[str, list[str]] = field(default_factory=dict)
    contact_fields: dict[str, list[str]] = field(default_factory=dict)


_RPSL_AS = {"description": ["descr"], "admin_c": ["admin-c"], "tech_c": ["tech-c"], "org_id": ["org"], "mnt_by": ["mnt-by"], "notify": ["notify"], "changed": ["changed"], "as_name": ["as-name"]}
_RPSL_ORG = {"admin_c": ["admin-c"], "tech_c": ["tech-c"], "phone": ["phone"], "org_id": ["organisation"], "org_name": ["org-name"], "notify": ["notify"], "mnt_ref": ["mnt-ref"], "street": ["address"], "changed": ["changed"], "mnt_by": ["mnt-by"]}
_RPSL_CONTACT = {"phone": ["phone"], "admin_c": ["admin-c"], "tech_c": ["tech-c"], "street": ["address"], "email": ["e-mail"], "mnt_by": ["mnt-by"]}
_ISO, _DAY, _DASHED = "yyyy-MM-dd'T'HH:mm:ss'Z'", "yyyyMMdd", "yyyy-MM-dd"
# Class keys, fields and time formats of the six registries.
REGISTRIES = {
    "afrinic": Registry("afrinic", "aut-num", "organisation", ("person", "role", "mntner"), "as-block", "changed", _DAY, 2, True, _RPSL_AS, _RPSL_ORG,
                        _RPSL_CONTACT | {"contact_name": ["person", "role", "mntner"]}),
    "ripe": Registry("ripe", "aut-num", "organisation", ("role", "mntner"), "as-block", "last-modified", _ISO, 1, True, _RPSL_AS, _RPSL_ORG,
                     _RPSL_CONTACT | {"contact_name": ["person", "mntner"]}),
    "apnic": Registry("apnic", "aut-num", "organisation", ("role", "mntner"), "as-block", "last-modified", _ISO, 1, True,
                      _RPSL_AS | {"owner_c": ["source"], "abuse_c": ["abuse-c"], "notify": [], "changed": []}, _RPSL_ORG | {"org_type": ["org-type"], "notify": [], "changed": []},
                      _RPSL_CONTACT | {"phone": ["phone", "fax-no"], "contact_name": ["role", "mntner"]}),
    "arin": Registry("arin", "ASHandle", "OrgID", ("POCHandle",), None, "Updated", _DASHED, 1, True,
                     {"description": ["Comment"], "tech_c": ["TechHandle"], "owner_c": ["Source"], "org_id": ["OrgID"], "noc_c": ["NOCHandle"], "as_name": ["ASName"], "abuse_c": ["AbuseHandle"]},
                     {"admin_c": ["OrgAdminHandle"], "tech_c": ["TechHandle", "OrgTechHandle"], "org_id": ["OrgID"], "org_name": ["OrgName"], "noc_c": ["OrgNOCHandle", "NOCHandle"], "street": ["Street"], "description": ["Comment"]},
                     {"phone": ["MobilePhone", "FaxPhone", "OfficePhone"], "contact_name": ["POCHandle"], "street": ["Street"], "email": ["Mailbox"]}),
    "jpirr": Registry("jpirr", "aut-num", None, ("mntner", "role", "person"), None, "changed", _DAY, 2, True,
                      _RPSL_AS | {"noc_c": ["NOCHandle"], "abuse_c": ["AbuseHandle"], "org_id": [], "notify": []}, {}, _RPSL_CONTACT | {"phone": ["fax-no", "phone"]}),
    "lacnic": Registry("lacnic", "aut-num", None, ("person", "mntner"), None, "changed", _DASHED, 1, True,
                       _RPSL_AS | {"admin_c": [], "org_id": [], "notify": []}, {}, _RPSL_CONTACT | {"admin_c": [], "contact_name": ["person", "mntner"]}),
}
#: ARIN lists numbers above this and objects delegated elsewhere only for reference.
ARIN_HIGHEST = 10_000_000
ARIN_FOREIGN = ["RIPE", "APNIC", "LACNIC", "AFRINIC", "IANA"]
_AS_COLUMNS = ["description", "admin_c", "tech_c", "owner_c", "org_id", "mnt_by", "noc_c", "notify", "changed", "as_name", "abuse_c"]
_ORG_COLUMNS = ["admin_c", "tech_c", "phone", "org_id", "org_name", "notify", "noc_c", "mnt_ref", "street", "changed", "mnt_by", "org_type", "description"]
_CONTACT_COLUMNS = ["phone", "admin_c", "tech_c", "contact_name", "street", "email", "mnt_by"]


def read_dump(spark: SparkSession, path: str, registry: str) -> DataFrame:
    """Raw records (RAW) of a registry's dump: one file, or a folder of files."""
    r = REGISTRIES[registry]
    keys = [k for k in (r.asn_class, r.org_class, *r.contact_classes, r.block_class) if k]
    spark.dataSource.register(RegistryDump)
    return spark.read.format("registry_dump").option("keys", ",".join(keys)).load(path)


def values(keys: list[str]) -> F.Column:
    """The values of the first-to-last keys joined; an empty list where none is there."""
    empty = F.array().cast("array<string>")
    return F.flatten(F.array(*(F.coalesce(F.try_element_at("attributes", F.lit(k)), empty) for k in keys))) if keys else empty


def _projection(fields: dict[str, list[str]], columns: list[str]) -> list[F.Column]:
    lower = lambda c: F.transform(c, F.lower)
    picked = {c: values(fields.get(c, [])) for c in columns}
    picked = {c: lower(v) if c == "org_id" else changed_email(v) if c == "changed" else v for c, v in picked.items()}
    return [v.alias(c) for c, v in picked.items()]


def _time(r: Registry) -> F.Column:
    words = F.transform(values([r.time_field]), lambda x: F.try_element_at(F.split(F.trim(x), r"\s+"), F.lit(r.time_word)))
    return latest_time(words, r.time_pattern)


def as_objects(raw: DataFrame, registry: str) -> DataFrame:
    """Autonomous systems: ``asn`` and the list columns; unparsable times are null, records without a number are dropped.

    ARIN's number ranges are expanded; its foreign and very high numbers are left out.
    """
    r = REGISTRIES[registry]
    has = raw.where(F.map_contains_key("attributes", F.lit(r.asn_class)))
    base = has.select("record_id", "file", "attributes")
    if registry == "arin":
        owner = F.upper(F.coalesce(F.try_element_at(values(["OrgID"]), F.lit(1)), F.lit("")))
        numbers = integer_range(F.coalesce(F.try_element_at(values(["ASNumber"]), F.lit(1)), F.try_element_at(values([r.asn_class]), F.lit(1))))
        base = base.where(~owner.isin(ARIN_FOREIGN)).withColumn("asn", F.explode(numbers)).where(F.try_element_at(numbers, F.lit(1)) <= ARIN_HIGHEST)
    else:
        base = base.withColumn("asn", asn_digits(F.try_element_at(values([r.asn_class]), F.lit(1)))).where("asn is not null")
    return base.select("asn", *_projection(r.asn_fields, _AS_COLUMNS), F.lit(registry).alias("rir"), _time(r).alias("changed_time"))


def org_objects(raw: DataFrame, registry: str) -> DataFrame:
    """Organisations; none where the registry has no such class."""
    r = REGISTRIES[registry]
    if registry == "arin":
        other = F.map_contains_key("attributes", F.lit("NetHandle")) | F.map_contains_key("attributes", F.lit("V6NetHandle")) | F.map_contains_key("attributes", F.lit(r.asn_class))
        rows = raw.where(F.map_contains_key("attributes", F.lit("OrgID")) & ~other)
    else:
        rows = raw.where(F.map_contains_key("attributes", F.lit(r.org_class))) if r.org_class else raw.limit(0)
    return rows.select(*_projection(r.org_fields, _ORG_COLUMNS), F.lit(registry).alias("rir"))


def contact_objects(raw: DataFrame, registry: str) -> DataFrame:
    """Contacts (people, roles, maintainers)."""
    r = REGISTRIES[registry]
    keys = F.map_keys("attributes")
    any_ = F.arrays_overlap(keys, F.array(*map(F.lit, r.contact_classes)))
    return raw.where(any_).select(*_projection(r.contact_fields, _CONTACT_COLUMNS), F.lit(registry).alias("rir"))


def as_blocks(raw: DataFrame, registry: str) -> DataFrame:
    """``low, high, rir, changed_time, assigned_to``: number blocks whose remarks name a registry."""
    r = REGISTRIES[registry]
    rows = raw.where(F.map_contains_key("attributes", F.lit(r.block_class))) if r.block_class else raw.limit(0)
    ends = F.transform(F.regexp_extract_all(F.try_element_at(values([r.block_class or ""]), F.lit(1)), F.lit(r"(\d+)"), F.lit(1)), lambda x: x.try_cast("bigint"))
    assigned = registry_of(F.concat(values(["remarks"]), values(["descr"])))
    out = rows.select(F.try_element_at(ends, F.lit(1)).alias("low"), F.try_element_at(ends, F.lit(2)).alias("high"), F.lit(registry).alias("rir"), _time(r).alias("changed_time"), assigned.alias("assigned_to"))
    return out.where("low <= high and assigned_to <> ''")
