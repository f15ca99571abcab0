"""Named queries and, where SQL can state them, the same result as DuckDB SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from assetflow.constants import CATEGORY_BY_EXT, SUPPORTED_CODECS
from assetflow.sources import views

Query = Callable[[SparkSession, str], DataFrame]

QUERIES: dict[str, Query] = {}
ORACLES: dict[str, str] = {}

_EXTS = ", ".join(f"'{e}'" for e in CATEGORY_BY_EXT)
_FOLDERS = " ".join(f"when '{e}' then '{f}'" for e, f in CATEGORY_BY_EXT.items())
_CODECS = ", ".join(f"'{c}'" for c in SUPPORTED_CODECS)


def _rate(column: str) -> str:
    both = f"regexp_full_match(coalesce({column}, ''), '[0-9]+/[0-9]+')"
    num, den = (f"try_cast(split_part({column}, '/', {i}) as double)" for i in (1, 2))
    return f"case when {both} and {den} <> 0 then {num} / {den} else 0.0 end"


# Views an oracle can build on, in order of dependence.
_SQL_VIEWS = {
    "assets": views.duckdb_sql(views.ASSETS),
    "files": f"""
        select a.*, case ext when '' then null {_FOLDERS} end as folder
        from (select *, regexp_extract(path, '[^/]+$') as name,
                     case when raw_ext in ({_EXTS}) then raw_ext end as ext
              from (select *, lower(regexp_extract(path, '[^/]\\.([^./]+)$', 1)) as raw_ext from assets)) a""",
    "texts": views.duckdb_sql(views.TEXTS),
    "video_probe": views.duckdb_sql(views.VIDEO_PROBE),
    "judged": f"""
        select *, case when codec is null then 'unopenable' when codec not in ({_CODECS}) then 'unsupported_codec'
                       when is_vfr then 'vfr' when is_short then 'too_short' else 'ok' end as verdict
        from (select *, r_fps > 0 and a_fps > 0 and abs(r_fps - a_fps) / greatest(r_fps, a_fps) > 0.01 as is_vfr,
                     coalesce(try_cast(nb_frames as bigint) < 8, false) as is_short
              from (select *, {_rate("r_frame_rate")} as r_fps, {_rate("avg_frame_rate")} as a_fps
                    from video_probe))""",
    "timings": views.duckdb_sql(views.TIMINGS),
    "bench": """
        select file_type, cast(sum(n_files) as bigint) as num_files,
          coalesce(sum(elapsed_sec) filter (engine = 'baseline' and not failed), 0.0) as baseline_sec,
          coalesce(sum(elapsed_sec) filter (engine = 'accel' and not failed), 0.0) as accel_sec,
          cast(coalesce(sum(n_files) filter (engine = 'baseline' and not failed), 0) as bigint) as baseline_ok_files,
          cast(coalesce(sum(n_files) filter (engine = 'accel' and not failed), 0) as bigint) as accel_ok_files,
          count(*) filter (engine = 'baseline' and failed) as baseline_errors,
          count(*) filter (engine = 'accel' and failed) as accel_errors,
          count(*) filter (engine = 'baseline') as baseline_batches,
          count(*) filter (engine = 'accel') as accel_batches
        from timings group by file_type""",
    "report": """
        select *, case when num_files = 0 then 0.0 else baseline_sec / num_files * 1000 end as baseline_avg_ms,
          case when num_files = 0 then 0.0 else accel_sec / num_files * 1000 end as accel_avg_ms,
          case when accel_sec > 0 and rate < 0.05 then baseline_sec / accel_sec end as speedup_ratio,
          case when accel_sec > 0 and rate < 0.05 then 'OK'
               else 'UNRELIABLE (err_rate=' || printf('%.1f', rate * 100) || '%)' end as data_quality
        from (select *, case when accel_batches = 0 then 0.0 else accel_errors / accel_batches end as rate,
                     case when num_files = 0 then 0.0 else accel_errors / num_files end as file_rate
              from bench)""",
    "signals": views.duckdb_sql(views.SIGNALS),
    "outcomes": views.duckdb_sql(views.OUTCOMES),
    "fourcc": views.duckdb_sql(views.FOURCC),
    "sheets": """
        select c_mktsegment as source_id, c_acctbal, null::double as o_totalprice from customer
        union all select o_orderstatus, null, o_totalprice from orders""",
}


def _with_views(sql: str, names: tuple[str, ...]) -> str:
    wanted: set[str] = set()

    def add(name: str) -> None:
        wanted.add(name)
        needs = {"files": ["assets"], "judged": ["video_probe"], "bench": ["timings"], "report": ["bench"]}
        for other in needs.get(name, []):
            add(other)

    for name in names:
        add(name)
    ctes = ", ".join(f"{n} as ({body})" for n, body in _SQL_VIEWS.items() if n in wanted)
    if not ctes:
        return sql
    return f"with {ctes}, {sql[5:]}" if sql.startswith("with ") else f"with {ctes} {sql}"


def query(name: str, sql: str | None = None, using: tuple[str, ...] = ()) -> Callable[[Query], Query]:
    """Register a query, with the SQL that must give the same rows."""

    def register(fn: Query) -> Query:
        if name in QUERIES:
            raise ValueError(f"query {name} exists already")
        QUERIES[name] = fn
        if sql is not None:
            ORACLES[name] = _with_views(sql.strip(), using)
        return fn

    return register
