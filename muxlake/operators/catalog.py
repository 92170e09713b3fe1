"""Discovery of PIDs through tables, the catalogue of PIDs and their roles, and what of it is missing.

Lists of PIDs are small for a source (8,192 at most); those of a whole corpus may not be, so Spark chooses how semi-joins are done.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from muxlake.functions.bits import uint, walk
from muxlake.functions.names import STREAM_TYPES, name_of
from muxlake.operators import descriptors as desc
from muxlake.operators import tables


def _has(loop, tag: int):
    """Whether a descriptor loop holds a tag."""
    return F.exists(walk(loop, 0, F.length(loop), 2, lambda pos: desc.entry_size(loop, pos)), lambda e: uint(loop, e["pos"]) == tag)


def pmt_pids(pat: DataFrame) -> DataFrame:
    """(source, program_number, pid) of the programmes, without the network's entry."""
    return tables.entries(pat, "PAT").where("program_number <> 0").select("source", "program_number", F.col("program_pid").alias("pid")).distinct()


def _streams(pmt: DataFrame) -> DataFrame:
    return tables.entries(pmt, "PMT").withColumn("signals_application", _has(F.col("entry_descriptors"), 0x6F))


def first_stream(pmt: DataFrame, stream_type: int) -> DataFrame:
    """The first elementary stream of a type in each programme."""
    own = _streams(pmt).where(F.col("stream_type") == stream_type)
    return own.groupBy("source", "program_number").agg(F.min_by(F.struct("es_pid", "signals_application"), "position").alias("e")).select("source", "program_number", "e.*")


def ait_pids(pmt: DataFrame) -> DataFrame:
    return first_stream(pmt, 0x05).where("signals_application").select("source", F.col("es_pid").alias("pid")).distinct()


def splice_pids(pmt: DataFrame) -> DataFrame:
    return first_stream(pmt, 0x86).select("source", F.col("es_pid").alias("pid")).distinct()


def warning_pids(pmt: DataFrame) -> DataFrame:
    """Private section streams that signal no application: candidates for emergency warnings."""
    return _streams(pmt).where("stream_type = 5 AND NOT signals_application").select("source", F.col("es_pid").alias("pid")).distinct()


def t2mi_pids(pat: DataFrame, pmt: DataFrame) -> DataFrame:
    """The stream of sources with exactly one programme, whose only elementary stream has type 6."""
    single = pmt_pids(pat).groupBy("source").agg(F.countDistinct("program_number").alias("n")).where("n = 1").select("source")
    es = tables.entries(pmt, "PMT").join(single, "source").groupBy("source").agg(F.countDistinct("es_pid").alias("n"), F.max("stream_type").alias("t"), F.max("es_pid").alias("pid"))
    return es.where("n = 1 AND t = 6").select("source", "pid")


def candidate_pids(packets: DataFrame, most: int = 32) -> DataFrame:
    """The lowest PIDs of each source that could carry private tables: the report has so many."""
    order = F.row_number().over(desc_window())
    return packets.where("NOT tei AND pid >= 256 AND pid <> 8191").select("source", "pid").distinct().withColumn("nth", order).where(F.col("nth") <= most).drop("nth")


def desc_window():
    from pyspark.sql.window import Window

    return Window.partitionBy("source").orderBy("pid")


def of_pids(packets: DataFrame, pids: DataFrame) -> DataFrame:
    """The packets on listed PIDs of their source; Spark broadcasts the list where it is small."""
    return packets.join(pids.select("source", "pid").distinct(), ["source", "pid"], "left_semi")


# Kinds of tables, the PIDs they have, in the order in which later roles win.
FIXED_ROLES = ((0x00, "PAT"), (0x01, "CAT"), (0x10, "NIT"), (0x11, "SDT/BAT"), (0x12, "EIT"), (0x14, "TDT/TOT"), (0x15, "MIP"))


def section_pids(pat: DataFrame, pmt: DataFrame, packets: DataFrame) -> DataFrame:
    """(source, pid) of everything that carries sections: the PIDs of fixed tables and those that PAT and PMT announce."""
    fixed = packets.select("source").distinct().select("source", F.explode(F.array(*(F.lit(p) for p in (0x00, 0x01, 0x10, 0x11, 0x12, 0x14)))).alias("pid"))
    found = [pmt_pids(pat).select("source", "pid"), ait_pids(pmt), splice_pids(pmt), warning_pids(pmt)]
    for df in found:
        fixed = fixed.union(df)
    return fixed.distinct()


def ca_pids(loops: DataFrame) -> DataFrame:
    """(source, pid) of the conditional access descriptors of loops(source, descriptors): ECM PIDs of programmes, EMM PIDs of a CAT."""
    return desc.typed(desc.split(loops.select("source", "descriptors"), "descriptors"), "dvb", 0x09).select("source", F.col("ca_pid").cast("int").alias("pid")).distinct()


def roles(pat: DataFrame, pmt: DataFrame, packets: DataFrame, cat: DataFrame | None = None) -> DataFrame:
    """(source, pid, role) of every PID that is observed or that tables announce; the most telling role wins."""
    fixed = packets.sparkSession.createDataFrame([(p, r, 0) for p, r in FIXED_ROLES], "pid int, role string, rank int")
    observed = packets.where("NOT tei AND pid <> 8191").select("source", "pid").distinct()
    named = lambda df, role, rank: df.select("source", "pid", F.lit(role).alias("role"), F.lit(rank).alias("rank"))
    es = tables.entries(pmt, "PMT").select("source", F.col("es_pid").alias("pid"))
    pcr = pmt.where("pcr_pid <> 8191").select("source", F.col("pcr_pid").alias("pid"))
    ecm = ca_pids(pmt)
    every = (
        observed.join(F.broadcast(fixed), "pid").select("source", "pid", "role", "rank")
        .union(named(pmt_pids(pat), "PMT", 5)).union(named(pcr, "PCR", 1)).union(named(es, "ES", 2)).union(named(ecm, "ECM", 3))
        .union(named(warning_pids(pmt), "EWS", 4)).union(named(ait_pids(pmt), "AIT", 5)).union(named(splice_pids(pmt), "SCTE-35", 5)).union(named(t2mi_pids(pat, pmt), "T2-MI", 5))
    )
    if cat is not None:
        every = every.union(named(ca_pids(cat), "EMM", 3))
    best = every.groupBy("source", "pid").agg(F.max_by("role", "rank").alias("role"))
    return best.join(observed.withColumn("observed", F.lit(True)), ["source", "pid"], "full_outer").select(
        "source", "pid", F.coalesce("role", F.lit("unknown")).alias("role"), F.coalesce("observed", F.lit(False)).alias("observed")
    )


def missing(catalogue: DataFrame) -> DataFrame:
    """What tables announce and no packet has."""
    return catalogue.where("NOT observed")


def _first_service(loops: DataFrame, column: str, keys: list[str]) -> DataFrame:
    """The first service descriptor of the newest table for each key: (keys, s)."""
    rows = desc.services(desc.split(loops.select(*keys, "first_offset", column), column))
    order = F.struct(-F.col("first_offset"), "position")
    return rows.groupBy(*keys).agg(F.min_by(F.struct("service_type", "provider", "service_name"), order).alias("s"))


def service_names(sdt: DataFrame, key: tuple[str, ...] | list[str] = ("source",)) -> DataFrame:
    """(key, service_id, service_type, provider, service_name): the first service descriptor of each service of the newest table."""
    keys = [*key, "service_id"]
    return _first_service(tables.entries(sdt, "SDT"), "entry_descriptors", keys).select(*keys, "s.*")


def services(pat: DataFrame, pmt: DataFrame, sdt: DataFrame, key: tuple[str, ...] | list[str] = ("source",)) -> DataFrame:
    """One row a programme or service: what each of the three tables last said of it, whichever of them is there.

    The service table's name wins; a programme's own service descriptor only fills in where that is blank. key: what tells streams apart, such as
    source, or source and plp_id; all three tables have it.
    """
    keys = [*key, "program_number"]
    listed = tables.entries(pat, "PAT").where("program_number <> 0")
    by_pat = listed.groupBy(*keys).agg(F.max_by("program_pid", F.struct("first_offset", "position")).alias("pmt_pid"))
    es = F.transform("es", lambda e: F.struct(e["stream_type"].alias("stream_type"), e["es_pid"].alias("es_pid")))
    newest = pmt.groupBy(*keys).agg(F.max_by(F.struct("pcr_pid", es.alias("streams")), "first_offset").alias("p"))
    own = _first_service(pmt, "descriptors", keys).select(*keys, F.col("s.service_name").alias("own_name"))
    by_pmt = newest.join(own, keys, "left").select(*keys, "p.*", "own_name")
    by_sdt = service_names(sdt, key).withColumnRenamed("service_id", "program_number")
    out = by_pat.join(by_pmt, keys, "full_outer").join(by_sdt, keys, "full_outer")
    blank = lambda c: F.expr(f"nullif(trim({c}), '')")
    return out.select(*keys, "pmt_pid", "pcr_pid", "streams", "service_type", blank("provider").alias("provider"), F.coalesce(blank("service_name"), blank("own_name")).alias("service_name"))


def service_report(found: DataFrame) -> DataFrame:
    """The services as lines of a text, in the order of their numbers."""
    streams = F.array_join(F.transform("streams", lambda e: F.concat_ws(" ", name_of(e["stream_type"], STREAM_TYPES), e["es_pid"].cast("string"))), ", ")
    line = F.concat_ws("; ", F.concat(F.lit("service "), F.col("program_number").cast("string")), "service_name", "provider", F.concat(F.lit("PMT "), F.col("pmt_pid").cast("string")), streams)
    return found.select("source", "program_number", line.alias("line")).orderBy("source", "program_number")
