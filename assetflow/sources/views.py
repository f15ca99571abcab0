"""Collections derived from the given tables.

The tables hold no media files, so these views stand for what a scan or a probe would return.
The SQL is common to Spark and DuckDB; the few names that differ are filled in per engine.
"""

from __future__ import annotations

import re

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

TABLES = (
    "region nation customer supplier part orders lineitem events documents embeddings pages "
    "benchmark labels conversations"
).split()

# A file listing. Names collide on purpose, and a path can occur twice.
ASSETS = """
select concat('/in/', source, '/', lang, '_', cast(doc_id % 400 as varchar(20)),
              case when doc_id % 7 = 0 then '.TXT' else '.txt' end) as path,
       doc_id as asset_id, cast(<bytes>(text) as bigint) as size_bytes
from {documents}
union all
select concat('/in/conv/c', cast(conv_id as varchar(20)), '/turn_', cast(turn as varchar(20)), '.json'),
       conv_id * 1000 + turn, cast(<bytes>(text) as bigint)
from {conversations}
union all
select concat('/in/sig/', cast(label as varchar(20)), '/clip_', cast(vec_id % 300 as varchar(20)), '.wav'),
       vec_id, cast(4 * <length>(embedding) as bigint)
from {embeddings}
union all
select concat('/in/vid/', p_brand, '/', replace(p_name, ' ', '_'), '_', cast(p_size as varchar(20)), '.mp4'),
       p_partkey, cast(<bytes>(p_type) as bigint)
from {part}
union all
select concat('/in/sheets/', c_mktsegment, '/cust_', cast(c_custkey % 1200 as varchar(20)), '.xlsx'),
       c_custkey, cast(<bytes>(c_name) as bigint)
from {customer}
union all
select concat('/in/web/p', cast(page_id as varchar(20)),
              case when page_id % 5 = 0 then '.tar.gz' when page_id % 5 = 1 then '' else '.html' end),
       page_id, cast(<bytes>(html) as bigint)
from {pages}
"""

# The text files among them with their contents.
TEXTS = """
select 'txt' as ext,
       concat('/in/', source, '/', lang, '_', cast(doc_id % 400 as varchar(20)),
              case when doc_id % 7 = 0 then '.TXT' else '.txt' end) as path,
       doc_id as asset_id, text
from {documents}
union all
select 'json',
       concat('/in/conv/c', cast(conv_id as varchar(20)), '/turn_', cast(turn as varchar(20)), '.json'),
       conv_id * 1000 + turn, text
from {conversations}
"""

# Probe results of the videos; a null codec is a file that could not be opened.
VIDEO_PROBE = """
select p_partkey as video_id,
  case when p_partkey % 11 = 0 then null when p_size % 10 < 5 then 'h264' when p_size % 10 = 5 then 'hevc'
       when p_size % 10 = 6 then 'vp09' when p_size % 10 = 7 then 'fmp4' when p_size % 10 = 8 then 'mjpg'
       else 'unknown' end as codec,
  case when p_partkey % 13 = 0 then '0/0' when p_partkey % 2 = 0 then '30000/1001' else '25/1' end as r_frame_rate,
  case when p_partkey % 17 = 0 then 'N/A' when p_partkey % 5 = 0 then '24/1' when p_partkey % 2 = 0 then '2997/100'
       else '25/1' end as avg_frame_rate,
  case when p_partkey % 19 = 0 then null when p_partkey % 23 = 0 then 'N/A'
       else cast(p_size as varchar(20)) end as nb_frames
from {part}
"""

# One row per attempted batch.
TIMINGS = """
select event_id as batch_id,
  case event_type when 'click' then 'txt' when 'view' then 'json' when 'purchase' then 'wav'
                  when 'signup' then 'xlsx' else 'mp4' end as file_type,
  case when user_id % 2 = 0 then 'baseline' else 'accel' end as engine,
  cast(1 + event_id % 200 as bigint) as n_files, value / 1000 as elapsed_sec,
  (event_type = 'error' and user_id % 2 = 1)
    or (event_type = 'purchase' and user_id % 2 = 1 and event_id % 8 = 0)
    or (event_id % 40 = 0) as failed,
  ts
from {events}
"""

# Clips of different lengths: neighbouring vectors of one label joined, interleaved over one or two
# channels. Every value of every vector is in one clip.
SIGNALS = """
select clip_id, batch_id, samples, 1 + clip_id % 2 as channels from (
  select min(vec_id) as clip_id, label as batch_id, <joined> as samples
  from {embeddings} group by label, vec_id - vec_id % (10 * (1 + label % 4)))
"""

# Results of repairing files, in input order.
OUTCOMES = """
select event_id as seq, cast(event_id as varchar(20)) as name, event_type <> 'error' as ok,
       case when event_type = 'error' then props end as err
from {events}
"""

# Packed codec codes.
FOURCC = """
select p_partkey as video_id,
  case when p_partkey % 29 = 0 then 538976288 when p_partkey % 31 = 0 then 828601953
       else 65 + p_size + 256 * (97 + p_partkey % 26) + 65536 * (48 + p_size % 10)
            + 16777216 * (32 + 17 * (p_partkey % 3)) end as code
from {part}
"""

_SPARK = {
    "<bytes>": "octet_length",
    "<length>": "cardinality",
    "<joined>": "flatten(transform(array_sort(collect_list(struct(vec_id, embedding))), x -> x.embedding))",
}
_DUCKDB = {
    "<bytes>": "strlen",
    "<length>": "len",
    "<joined>": "flatten(list(embedding order by vec_id))",
}


def _fill(sql: str, names: dict[str, str]) -> str:
    for mark, name in names.items():
        sql = sql.replace(mark, name)
    return sql


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def view(spark: SparkSession, sf_dir: str, sql: str, read=table) -> DataFrame:
    """One of the views above; ``read`` may return streams instead of tables."""
    names = sorted(set(re.findall(r"{(\w+)}", sql)))
    return spark.sql(_fill(sql, _SPARK), **{n: read(spark, sf_dir, n) for n in names})


def duckdb_sql(sql: str) -> str:
    """The same view over tables of the same names in DuckDB."""
    return re.sub(r"{(\w+)}", r"\1", _fill(sql, _DUCKDB)).strip()


def signals(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Clips with ``waveform``, one array per channel."""
    clips = view(spark, sf_dir, SIGNALS)
    left = F.filter("samples", lambda _, i: i % 2 == 0)
    right = F.filter("samples", lambda _, i: i % 2 == 1)
    waveform = F.when(F.col("channels") == 1, F.array("samples")).otherwise(F.array(left, right))
    return clips.withColumn("waveform", waveform).drop("samples")


def sheet_layouts(spark: SparkSession, sf_dir: str) -> list[DataFrame]:
    """Sheets in two layouts; ``source_id`` names the sheet."""
    customer = table(spark, sf_dir, "customer").withColumnRenamed("c_mktsegment", "source_id")
    orders = table(spark, sf_dir, "orders").withColumnRenamed("o_orderstatus", "source_id")
    return [customer, orders]


def json_docs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents meant to be JSON, and some that are not: kind, doc_key, text."""
    props = table(spark, sf_dir, "events").select(
        F.lit("props").alias("kind"), F.col("event_id").alias("doc_key"), F.col("props").alias("text")
    )
    turns = table(spark, sf_dir, "conversations").select(
        F.lit("turn").alias("kind"),
        (F.col("conv_id") * 1000 + F.col("turn")).alias("doc_key"),
        F.to_json(F.struct("conv_id", "turn", "role", "text")).alias("text"),
    )
    texts = table(spark, sf_dir, "documents").select(
        F.lit("text").alias("kind"), F.col("doc_id").alias("doc_key"), "text"
    )
    return props.unionByName(turns).unionByName(texts)
