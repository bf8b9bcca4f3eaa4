"""Registry, and the views of the test tables in the checking dialect."""

from __future__ import annotations

import functools
from collections.abc import Callable

from brickwork.session import ship_package

QUERIES: dict[str, Callable] = {}
ORACLE: dict[str, str] = {}

VIEWS = {
    "flat_voxel": """
        select l_suppkey % 16 as block_id, cast(floor(l_extendedprice) as bigint) % 65536 as v from lineitem""",
    "voxel": """
        select vec_id as block_id, i as pos, i // 16 as x, (i // 4) % 4 as y, i % 4 as z,
               cast(floor((cast(e as double) + 1.0) * 32767.5) as bigint) as v
        from (select vec_id, unnest(embedding) as e, unnest(range(0, 64)) as i from embeddings)""",
    "block": """
        select block_id, '/data/block-' || cast(block_id as varchar) || '.nii' as path,
               list(v order by pos) as v
        from voxel group by block_id""",
    # Planes per image: the greatest depth up to 64 that gives all images the same shape.
    "depth": """
        select max(d) as depth from (select unnest(range(1, 65)) as d)
        where (select count(*) from embeddings) % d = 0""",
    "plane": """
        select vec_id // depth as block_id, i % 8 as x, i // 8 as y, vec_id % depth as z, depth,
               cast(floor((cast(e as double) + 1.0) * 32767.5) as bigint) as v,
               'image-' || lpad(cast(vec_id // depth as varchar), 8, '0') || '.nii' as name
        from (select vec_id, unnest(embedding) as e, unnest(range(0, 64)) as i from embeddings) cross join depth""",
    "donor": """
        select block_id, it, (block_id * 31 + it * 17 + 1234) % (select count(*) from embeddings) as donor
        from (select vec_id as block_id, unnest(range(0, 3)) as it from embeddings)""",
    "image": """
        select 'site-' || cast(label as varchar) as site, cast(vec_id as varchar) as subject, vec_id as image_id,
               '/cohort/site-' || cast(label as varchar) || '/sub-a-' || cast(vec_id as varchar) || '/anat/T1w.nii' as path
        from embeddings""",
    "trace0": """
        select event_id as seq,
          case event_type when 'error' then 'load' when 'click' then 'increment' when 'view' then 'calculate_histogram'
            when 'purchase' then 'dump' else 'combine_histogram' end as func,
          epoch_us(ts) - epoch_us(TIMESTAMP '2024-01-01') as start_us,
          epoch_us(ts) - epoch_us(TIMESTAMP '2024-01-01') + cast(round(value * 1000000) as bigint) as end_us,
          'file-' || cast(event_id % 50 as varchar) || '.nii' as filename,
          'node-' || cast(user_id % 8 as varchar) || '.local' as worker,
          user_id as thread, user_id % 32 as process,
          case when event_id % 2 = 0 then 'spark' else 'dask' end as framework,
          cast(case (event_id // 2) % 3 when 0 then 2 when 1 then 4 else 8 end as bigint) as n_worker,
          (event_id // 6) % 10 as rep
        from events""",
    "trace": """
        select *,
          framework || ':increment:n_worker=' || cast(n_worker as varchar) || ':block_size=''5000'':iterations='
            || case when rep = 9 then '25' else '5' end || ':delay=1.0' as label,
          framework || '-' || cast(n_worker as varchar) || '-' || cast(rep as varchar) as run_id
        from trace0""",
    # Names as reports show them, and the process as thread for runs of Spark.
    "shown": """
        select * replace (
          case func when 'dump' then 'Write' when 'load' then 'Read'
            else upper(func[1:1]) || lower(func[2:]) end as func,
          case when framework = 'spark' then process else thread end as thread)
        from trace""",
}

_NEEDS = {"block": ["voxel"], "plane": ["depth"], "trace": ["trace0"], "shown": ["trace0", "trace"]}


def with_views(*names: str, body: str, **extra: str) -> str:
    """SQL text: the named views, then ``extra`` ones, then ``body``."""
    ordered: list[str] = []
    for name in names:
        for view in [*_NEEDS.get(name, []), name]:
            if view not in ordered:
                ordered.append(view)
    parts = [f"{n} as ({VIEWS[n]})" for n in ordered] + [f"{n} as ({text})" for n, text in extra.items()]
    return f"with {', '.join(parts)} {body}"


def query(name: str, sql: str | None = None):
    """Register a query and, where one exists, its checking SQL."""

    def add(function: Callable) -> Callable:
        @functools.wraps(function)
        def run(spark, sf_dir):
            ship_package(spark)
            return function(spark, sf_dir)

        QUERIES[name] = run
        if sql is not None:
            ORACLE[name] = sql
        return function

    return add
