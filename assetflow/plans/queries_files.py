"""Queries on listings, names, batches and sheets."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from assetflow.functions import paths
from assetflow.operators import batching, inventory, naming, organize
from assetflow.plans.catalog import query
from assetflow.plans.jobs import organize_collection
from assetflow.shared import new_path, stage
from assetflow.sources import files as file_sources
from assetflow.sources import sheets as sheet_sources
from assetflow.sources import sheetcache, views


def _assets(spark: SparkSession, sf: str) -> DataFrame:
    return inventory.classify(views.view(spark, sf, views.ASSETS))


def _supported(spark: SparkSession, sf: str) -> DataFrame:
    return inventory.supported(_assets(spark, sf))


def _land_texts(spark: SparkSession, sf: str) -> str:
    """Write the documents as text files, a folder per source; every text ends a line."""
    root = new_path(spark, "landed")
    views.table(spark, sf, "documents").select("source", "text").write.partitionBy("source").text(root)
    return root


# ------------------------------------------------------------------ scans


@query(
    "scan_files",
    "select source, cast(sum(strlen(text) + 1) as bigint) as total_bytes from documents group by source",
)
def scan_files(spark, sf):
    found = file_sources.scan_files(spark, _land_texts(spark, sf))
    source = F.regexp_extract("path", "/source=([^/]*)/", 1)
    return found.groupBy(source.alias("source")).agg(F.sum("size_bytes").alias("total_bytes"))


@query(
    "scan_by_glob",
    "select cast(sum(strlen(text) + 1) as bigint) as total_bytes from documents",
)
def scan_by_glob(spark, sf):
    root = new_path(spark, "landed")
    views.table(spark, sf, "documents").select("text").write.text(root)
    views.table(spark, sf, "conversations").write.mode("append").json(root)
    views.table(spark, sf, "pages").select(F.col("html").alias("value")).write.text(f"{root}/below")
    return file_sources.scan_by_glob(spark, root, "*.txt").agg(F.sum("size_bytes").alias("total_bytes"))


@query("classify_ext", "select path, asset_id, ext from files", ("files",))
def classify_ext(spark, sf):
    return _assets(spark, sf).select("path", "asset_id", "ext")


@query(
    "inventory_by_ext",
    "select ext, count(*) as num_files, cast(sum(size_bytes) as bigint) as total_bytes from files "
    "where ext is not null group by ext",
    ("files",),
)
def inventory_by_ext(spark, sf):
    return inventory.count_by_ext(_assets(spark, sf))


@query("inventory_total", "select count(*) as num_files from files where ext is not null", ("files",))
def inventory_total(spark, sf):
    return _supported(spark, sf).agg(F.count("*").alias("num_files"))


@query("category_map", "select path, asset_id, ext, folder from files", ("files",))
def category_map(spark, sf):
    dim = F.broadcast(inventory.category_table(spark))  # five rows
    return (
        _assets(spark, sf).drop("folder").join(dim, "ext", "left").select("path", "asset_id", "ext", "folder")
    )


@query("supported_only", "select path, asset_id, ext from files where ext is not null", ("files",))
def supported_only(spark, sf):
    return _supported(spark, sf).select("path", "asset_id", "ext")


@query("unsupported_assets", "select path, asset_id, raw_ext from files where ext is null", ("files",))
def unsupported_assets(spark, sf):
    rest = inventory.unsupported(_assets(spark, sf))
    return rest.select("path", "asset_id", paths.extension(F.col("path")).alias("raw_ext"))


@query("nonempty_groups", "select distinct ext, folder from files where ext is not null", ("files",))
def nonempty_groups(spark, sf):
    counts = inventory.count_by_ext(_assets(spark, sf))
    dim = F.broadcast(inventory.category_table(spark))
    return counts.join(dim, "ext").filter(F.col("num_files") > 0).select("ext", "folder")


@query(
    "max_group_size",
    "select coalesce(max(n), 0) as max_group_size from "
    "(select count(*) as n from files where ext is not null group by ext)",
    ("files",),
)
def max_group_size(spark, sf):
    return inventory.max_group_size(_supported(spark, sf), "ext")


@query(
    "sort_by_path",
    "select path, asset_id from files where ext = 'mp4' order by path, asset_id",
    ("files",),
)
def sort_by_path(spark, sf):
    return (
        _assets(spark, sf).filter(F.col("ext") == "mp4").select("path", "asset_id").orderBy("path", "asset_id")
    )


# ------------------------------------------------------------------ names and copies

_NAMES_SQL = """
    select path, asset_id, folder, name, slot,
      case when slot = 0 then name
           else regexp_replace(name, '\\.[^.]+$', '') || '_' || slot || regexp_extract(name, '\\.[^.]+$') end as dest_name
    from (select *, row_number() over (partition by folder, name order by path, asset_id) - 1 as slot
          from files where folder is not null)
"""


@query("unique_names", _NAMES_SQL, ("files",))
def unique_names(spark, sf):
    return naming.unique_names(_supported(spark, sf))


@query(
    "organize_plan",
    f"select path, asset_id, folder, dest_name, '/out/' || folder || '/' || dest_name as dest from ({_NAMES_SQL})",
    ("files",),
)
def organize_plan(spark, sf):
    plan = organize.organize_plan(_assets(spark, sf), root="/out")
    return plan.select("path", "asset_id", "folder", "dest_name", "dest")


@query(
    "organize_copy",
    "select 'text' as folder, true as all_ok, cast(sum(strlen(text) + 1) as bigint) as total_bytes from documents",
)
def organize_copy(spark, sf):
    destination = new_path(spark, "organized")
    copied = organize_collection(spark, _land_texts(spark, sf), destination)
    stored = file_sources.scan_files(spark, destination)
    return (
        copied.join(stored.select(paths.file_name(F.col("path")).alias("dest_name"), F.col("size_bytes").alias("stored")),
                    paths.file_name(F.col("dst")) == F.col("dest_name"), "full")
        .groupBy(F.element_at(F.split("dst", "/"), -2).alias("folder"))
        .agg(
            F.every(F.col("ok") & (F.col("size_bytes") == F.col("stored"))).alias("all_ok"),
            F.sum("stored").alias("total_bytes"),
        )
    )


@query(
    "write_by_category",
    "select folder, count(*) as num_files, cast(sum(size_bytes) as bigint) as total_bytes from files "
    "where folder is not null group by folder",
    ("files",),
)
def write_by_category(spark, sf):
    path = new_path(spark, "categories")
    organize.write_by_category(_assets(spark, sf).select("path", "size_bytes", "folder"), path)
    return (
        spark.read.parquet(path)
        .groupBy("folder")
        .agg(F.count("*").alias("num_files"), F.sum("size_bytes").alias("total_bytes"))
    )


# ------------------------------------------------------------------ batches


@query(
    "batch_assign",
    """select path, asset_id, ext, codec,
              (row_number() over (partition by ext, codec order by path, asset_id) - 1) // 200 as batch_id
       from (select f.path, f.asset_id, f.ext, v.codec from files f
             left join video_probe v on f.ext = 'mp4' and v.video_id = f.asset_id
             where f.ext is not null)""",
    ("files", "video_probe"),
)
def batch_assign(spark, sf):
    return batching.batch_assign(
        with_codec(spark, sf).select("path", "asset_id", "ext", "codec"), ["ext", "codec"], ["path", "asset_id"]
    )


_SIZES_SQL = """
    select ext, batch_id, count(*) as n_files
    from (select ext, (row_number() over (partition by ext order by path, asset_id) - 1) // 200 as batch_id
          from files where ext is not null) group by ext, batch_id
"""


@query("batch_sizes", _SIZES_SQL, ("files",))
def batch_sizes(spark, sf):
    return batching.batch_sizes(_supported(spark, sf), ["ext"])


@query(
    "progress_marks",
    f"""select * from (
          select ext, batch_id, n_files,
                 cast(sum(n_files) over (partition by ext order by batch_id) as bigint) as processed
          from ({_SIZES_SQL})) where processed % 250 < 200""",
    ("files",),
)
def progress_marks(spark, sf):
    return batching.progress_marks(_supported(spark, sf), ["ext"])


@query(
    "first_n_per_type",
    """select path, asset_id, ext, rn from
         (select path, asset_id, ext, row_number() over (partition by ext order by path, asset_id) as rn
          from files where ext is not null) where rn <= 100""",
    ("files",),
)
def first_n_per_type(spark, sf):
    needed = _supported(spark, sf).select("path", "asset_id", "ext")
    return batching.first_n(needed, ["ext"], ["path", "asset_id"], 100)


# ------------------------------------------------------------------ joins on files


def with_codec(spark: SparkSession, sf: str) -> DataFrame:
    """Supported files; videos with their codec. Only videos take part in the join."""
    probes = views.view(spark, sf, views.VIDEO_PROBE).select("video_id", "codec")
    videos, others = inventory.split(_supported(spark, sf), F.col("ext") == "mp4")
    found = videos.join(probes, videos.asset_id == probes.video_id, "left").drop("video_id")
    return found.unionByName(others.withColumn("codec", F.lit(None).cast("string")))


@query(
    "join_lookup",
    """select f.path, f.asset_id, f.ext, v.codec from files f
       left join video_probe v on f.ext = 'mp4' and v.video_id = f.asset_id where f.ext is not null""",
    ("files", "video_probe"),
)
def join_lookup(spark, sf):
    return with_codec(spark, sf).select("path", "asset_id", "ext", "codec")


# ------------------------------------------------------------------ sheets


def _land_sheets(spark: SparkSession, sf: str) -> tuple[str, str]:
    """Write each sheet as CSV files with a header, a folder per sheet."""
    roots = []
    for sheet in views.sheet_layouts(spark, sf):
        root = new_path(spark, "sheets")
        sheet.write.partitionBy("source_id").csv(root, header=True)
        roots.append(root)
    return tuple(roots)


def _sheets(spark: SparkSession, sf: str) -> DataFrame:
    return sheet_sources.union_ragged(views.sheet_layouts(spark, sf))


_SHEETS_SQL = """
    select source_id, count(*) as num_rows, round(sum(c_acctbal), 2) as acctbal, round(sum(o_totalprice), 2) as totalprice,
           count(*) filter (c_acctbal is null) as without_acctbal
    from sheets group by source_id
"""


def _sheet_summary(sheets: DataFrame) -> DataFrame:
    return sheets.groupBy("source_id").agg(
        F.count("*").alias("num_rows"),
        F.round(F.sum("c_acctbal"), 2).alias("acctbal"),
        F.round(F.sum("o_totalprice"), 2).alias("totalprice"),
        F.count_if(F.col("c_acctbal").isNull()).alias("without_acctbal"),
    )


@query(
    "read_sheets",
    f"""select *, cast(null as bigint) as note_chars from ({_SHEETS_SQL})
        union all select 'notes', count(*), null, null, count(*), cast(sum(length(text)) as bigint) from documents""",
    ("sheets",),
)
def read_sheets(spark, sf):
    # Texts are cells with quotes, commas and line breaks.
    notes = new_path(spark, "notes")
    texts = views.table(spark, sf, "documents").select("doc_id", F.col("text").alias("note"))
    texts.write.option("escape", '"').csv(f"{notes}/source_id=notes", header=True)
    layouts = [(root, None) for root in _land_sheets(spark, sf)]
    read = sheet_sources.read_sheets(spark, [*layouts, (notes, "doc_id long, note string")])
    source = F.regexp_extract("source_id", "/source_id=([^/]*)/", 1)
    rows = read.withColumn("source_id", source)
    chars = rows.groupBy("source_id").agg(F.sum(F.length("note")).alias("note_chars"))
    return _sheet_summary(rows).join(chars, "source_id")


@query("union_ragged", _SHEETS_SQL, ("sheets",))
def union_ragged(spark, sf):
    return _sheet_summary(_sheets(spark, sf))


@query("sheet_row_total", "select count(*) as num_rows from sheets", ("sheets",))
def sheet_row_total(spark, sf):
    return _sheets(spark, sf).agg(F.count("*").alias("num_rows"))


@query(
    "union_stack",
    "select count(*) as num_files, cast(sum(length(text)) as bigint) as total_chars from texts",
    ("texts",),
)
def union_stack(spark, sf):
    frames = [views.table(spark, sf, t).select("text") for t in ("documents", "conversations")]
    return sheet_sources.union_stack(frames).agg(
        F.count("*").alias("num_files"), F.sum(F.length("text")).alias("total_chars")
    )


@query(
    "read_parquet_many",
    "select count(*) as num_rows, count(distinct p_partkey) as num_parts, cast(sum(p_size) as bigint) as total_size from part",
)
def read_parquet_many(spark, sf):
    part = views.table(spark, sf, "part")
    written = []
    for rows in inventory.split(part, F.col("p_size") <= 25):
        written.append(new_path(spark, "parts"))
        rows.write.parquet(written[-1])
    return sheet_sources.read_parquet_many(spark, written).agg(
        F.count("*").alias("num_rows"),
        F.count_distinct("p_partkey").alias("num_parts"),
        F.sum("p_size").alias("total_size"),
    )


@query(
    "nonempty_frames",
    "select source_id, count(*) as num_rows from sheets group by source_id",
    ("sheets",),
)
def nonempty_frames(spark, sf):
    # Regions are listed as sources too, and have no rows.
    names = views.table(spark, sf, "region").select(F.col("r_name").alias("source_id"))
    sheets = _sheets(spark, sf)
    listed = sheets.select("source_id").union(names).distinct()
    return sheet_sources.nonempty_sources(sheets, listed)


_CACHED_FIRST = "source_id < 'G'"  # the sheets that are in the cache beforehand

# Regions are listed as sources too, with a sheet that has a header only.
_LISTED_SQL = """
    select source_id, count(*) as num_rows from sheets group by source_id
    union all select r_name, 0 from region
"""


def _half_cached(spark: SparkSession, sf: str) -> tuple[DataFrame, str]:
    """(listing of the landed sheets' files, cache with a part of them)."""
    roots = list(_land_sheets(spark, sf))
    empty = views.table(spark, sf, "region").select(F.col("r_name").alias("source_id"))
    header = ",".join(c for c in views.sheet_layouts(spark, sf)[0].columns if c != "source_id")
    roots.append(new_path(spark, "sheets"))
    empty.select(F.lit(header).alias("value"), "source_id").write.partitionBy("source_id").text(roots[-1])
    found = reduce(DataFrame.union, [file_sources.scan_files(spark, root) for root in roots])
    listing = found.withColumn("source_id", F.regexp_extract("path", "/source_id=([^/]*)/", 1))
    cache = new_path(spark, "cache")
    sheetcache.convert_missing(listing.filter(_CACHED_FIRST), cache)
    return listing, cache


@query(
    "cache_incremental",
    f"""select source_id, num_rows, source_id >= 'G' as added,
               (select count(*) from ({_LISTED_SQL}) where source_id >= 'G') as converted
        from ({_LISTED_SQL})""",
    ("sheets",),
)
def cache_incremental(spark, sf):
    listing, cache = _half_cached(spark, sf)
    before = stage(sheetcache.manifest(spark, cache).select("source_id", F.lit(True).alias("_known")).distinct(), "before")
    sheetcache.convert_missing(listing, cache)
    cached = sheetcache.read_converted(spark, cache).groupBy("source_id").agg(F.count("*").alias("num_rows"))
    sources = sheetcache.manifest(spark, cache).select("source_id").distinct().join(before, "source_id", "left")
    converted = sources.where("_known is null").count()
    return (
        sources.join(cached, "source_id", "left")
        .fillna(0, subset=["num_rows"])
        .withColumn("added", F.col("_known").isNull())
        .withColumn("converted", F.lit(converted).cast("long"))
        .drop("_known")
    )


@query("cache_require", f"select source_id from ({_LISTED_SQL}) where source_id >= 'G'", ("sheets",))
def cache_require(spark, sf):
    listing, cache = _half_cached(spark, sf)
    # What is cached passes the check, which raises otherwise.
    sheetcache.require(listing.filter(_CACHED_FIRST), cache)
    return sheetcache.missing_files(listing, cache).select("source_id").distinct()


@query(
    "join_anti_cache",
    f"select source_id, num_rows from ({_LISTED_SQL}) where source_id >= 'G' and num_rows > 0",
    ("sheets",),
)
def join_anti_cache(spark, sf):
    listing, cache = _half_cached(spark, sf)
    todo = sheetcache.missing_files(listing, cache)
    rest = new_path(spark, "cache")
    sheetcache.convert_missing(todo, rest)
    return sheetcache.read_converted(spark, rest).groupBy("source_id").agg(F.count("*").alias("num_rows"))
