"""SQL twins of the registered queries, written for DuckDB over the same tables."""

from __future__ import annotations

from hashwave import queries as q
from hashwave.sources.event_posts import REPLAY_SLICE, REPLAY_SLICES, REPLAY_START

# Common table expressions, each using only those above it in its chain.

_CTES = {
    "tweets": """
        select id, created_at, screen_name, retweet_count, tag1, tag2, mention1, mention2, original,
               case when event_type = 'view' then ' user' || (k % 30) || ' ' end as reply_to,
               case when k % 4 <> 0 then n_name end as place_full_name,
               case when k % 4 <> 0 then ((user_id * 17) % 180 - 90)::double + 0.25 end as place_lat,
               case when k % 4 <> 0 then ((user_id * 37) % 360 - 180)::double + 0.5 end as place_lng,
               case when k % 6 = 0 then ((id * 7) % 180 - 90)::double end as pt_lat,
               case when k % 6 = 0 then ((id * 13) % 360 - 180)::double end as pt_lng,
               list_filter([tag1, tag2], lambda t: t is not null) as entity_tags,
               list_filter([mention1, mention2], lambda m: m is not null) as entity_mentions,
               case when original is not null then 'RT @' || original || ': ' else '' end || 'hello'
               || case when tag1 is not null then ' #' || tag1 else '' end
               || case when tag2 is not null then '  #' || tag2 else '' end
               || case when k % 11 = 0 then ' #' || event_type else '' end
               || case when k % 13 = 0 then ' # ##dbl' else '' end
               || case when k % 17 = 0 then chr(10) || '#glued' else '' end
               || case when k % 7 = 0 then ' #comma,' else '' end
               || ' ' as text
        from (
            select *,
                   case when k % 10 <> 7 then
                        case when k % 2 = 0 then event_type else upper(event_type) end end as tag1,
                   case when k % 3 = 0 then 'k' || (k % 10) end as tag2,
                   case when k % 2 = 1 then 'user' || ((user_id * 7 + k) % 150) end as mention1,
                   case when k % 5 = 0 then 'user' || (k % 20) end as mention2,
                   case when event_type in ('click', 'purchase')
                        then 'user' || ((user_id + k) % 25) end as original
            from (
                select event_id as id, ts as created_at, user_id, event_type,
                       'user' || user_id as screen_name,
                       floor(value)::bigint as retweet_count,
                       json_extract_string(props, '$.k')::integer as k,
                       n_name
                from events left join nation on n_nationkey = user_id % 25
            )
        )
    """,
    "tagged": """
        select *, list_transform(
                   list_filter(string_split(text, ' '), lambda w: starts_with(w, '#') and length(w) > 1),
                   lambda w: substr(w, 2)) as tags
        from tweets
    """,
    "uses": """
        select id, created_at, unnest(range(len(tags)))::integer as pos, unnest(tags) as hashtag,
               place_lat as lat, place_lng as lng
        from tagged where place_lat is not null
    """,
    "geo": f"""
        select lower(hashtag) as hashtag, timebucket, lat, lng
        from (select *, (floor(epoch(created_at) / 3600)::bigint + 1) * 3600 as timebucket from uses)
        qualify row_number() over (
            partition by lower(hashtag), timebucket order by created_at desc, id desc, pos desc) = 1
    """,
    "ranges": """
        select hashtag, min(timebucket) as oldest, max(timebucket) as newest from geo group by hashtag
    """,
    "live": """
        select id, created_at, unnest(range(len(entity_tags)))::integer as pos,
               lower(unnest(entity_tags)) as hashtag,
               case when pt_lat is not null then pt_lat else place_lat end as lat,
               case when pt_lat is not null then pt_lng else place_lng end as lng
        from tweets where pt_lat is not null or place_lat is not null
    """,
    "reshares": """
        select id, created_at, unnest(tags) as hashtag, original as user_handle,
               screen_name as reshared_by
        from tagged where original is not null
    """,
    "totals": """
        select lower(hashtag) as hashtag, user_handle, count(*) as count
        from reshares group by lower(hashtag), user_handle
    """,
    "top": """
        select *, (row_number() over (
                   partition by hashtag order by count desc, user_handle))::integer as rank
        from totals qualify rank <= 3
    """,
    "profiles": """
        select screen_name as user_handle, description, followers_count, friends_count,
               case when contains(url, '_normal')
                    then split_part(url, '_normal', 1) || '_400x400' || split_part(url, '_normal', 2)
                    else url end as avatar_url
        from (
            select 'user' || (c_custkey + 1) as screen_name, c_mktsegment as description,
                   floor(c_acctbal)::bigint as followers_count, c_nationkey::bigint as friends_count,
                   'http://img.example.com/' || c_custkey
                   || case when c_custkey % 10 = 0 then '.png' else '_normal.png' end as url
            from customer
        )
    """,
    "ranked": """
        select *, screen_name as user_handle,
               row_number() over (partition by screen_name order by id desc) as rn
        from tweets
    """,
    "timeline": "select * from ranked where rn <= 600",
    "items": """
        select user_handle, rn, 'hashtags' as metric, unnest(entity_tags) as item,
               unnest(range(len(entity_tags))) as pos from timeline
        union all
        select user_handle, rn, 'mentions', unnest(entity_mentions),
               unnest(range(len(entity_mentions))) from timeline
        union all
        select user_handle, rn, 'replies', trim(reply_to), 0 from timeline where reply_to is not null
        union all
        select user_handle, rn, 'locations', place_full_name, 0
        from timeline where place_full_name is not null
    """,
    "item_counts": """
        select user_handle, metric, item, count(*) as count,
               min(rn * 4294967296 + pos)::bigint as first_seen
        from items group by user_handle, metric, item
    """,
    "item_ranks": """
        select *, (row_number() over (
                   partition by user_handle, metric order by count desc, first_seen))::integer as rank
        from item_counts
    """,
    "averages": """
        select user_handle, sum(retweet_count)::double / count(*)::double as avg_retweets
        from timeline group by user_handle
    """,
    "legend_ranges": """
        select event_type || '_' || event_id as hashtag, floor(epoch(ts))::bigint as oldest,
               floor(epoch(ts))::bigint + event_id * 37 % 400000 as newest
        from events
    """,
}

_USES = {
    "tagged": ["tweets"],
    "uses": ["tagged"],
    "geo": ["uses"],
    "ranges": ["geo"],
    "live": ["tweets"],
    "reshares": ["tagged"],
    "totals": ["reshares"],
    "top": ["totals"],
    "ranked": ["tweets"],
    "timeline": ["ranked"],
    "items": ["timeline"],
    "item_counts": ["items"],
    "item_ranks": ["item_counts"],
    "averages": ["timeline"],
}


def _with(body: str, *tables: str, **extra: str) -> str:
    """A statement over some of the common tables, plus any of its own."""
    needed: list[str] = []

    def need(name: str) -> None:
        for below in _USES.get(name, []):
            need(below)
        if name not in needed:
            needed.append(name)

    for name in tables:
        need(name)
    parts = [f"{name} as ({_CTES[name]})" for name in needed]
    parts += [f"{name} as ({text})" for name, text in extra.items()]
    return f"with {', '.join(parts)} {body}" if parts else body


def _bucket_end(seconds: int) -> str:
    return f"(floor(epoch(created_at) / {seconds})::bigint + 1) * {seconds}"


def _label(seconds: str, unit: str | None = None) -> str:
    size = {"sec": 1, "minute": 60, "hr": 3600, "day": 86400}
    if unit:
        return f"(floor(floor({seconds}) / {size[unit]})::bigint || ' {unit}(s)')"
    return f"""(case when floor({seconds}) >= 86400 then {_label(seconds, 'day')}
                when floor({seconds}) >= 3600 then {_label(seconds, 'hr')}
                when floor({seconds}) >= 60 then {_label(seconds, 'minute')}
                else floor({seconds})::bigint || ' sec' end)"""


# One row per slice, labels carried forward by a window. Bounds, colours and labels are fixed values.
_SLICES = """
    select * from (values
        (1, 0.0::double, 0.2::double, '#43C6DB'), (2, 0.2::double, 0.4::double, '#FF69B4'),
        (3, 0.4::double, 0.6::double, '#FBB917'), (4, 0.6::double, 0.8::double, '#C36241'),
        (5, 0.8::double, 1.0::double, '#4B0082')) as s(slice, lo, hi, colour)
"""


def _legend_ctes(ranges: str) -> dict[str, str]:
    end = "hi * span"
    return {
        "slices": _SLICES,
        "labelled": f"""
            select hashtag, slice, colour, {_label('lo * span')} as s, {_label(end)} as e,
                   case when floor({end}) >= 86400 then {_label(end, 'hr')}
                        when floor({end}) >= 3600 then {_label(end, 'minute')}
                        when floor({end}) >= 60 then {_label(end, 'sec')}
                        else {_label(end)} end as finer
            from (select *, (newest - oldest)::double as span from {ranges}), slices
        """,
        "carried": """
            select *, last_value(case when s = e then finer end ignore nulls) over (
                       partition by hashtag order by slice
                       rows between unbounded preceding and 1 preceding) as earlier
            from labelled
        """,
        "legend": """
            select hashtag, slice, start_label, end_label, start_label || ' - ' || end_label as name,
                   colour, substr(colour, 2) || '.gif' as icon
            from (select *, case when s = e then coalesce(earlier, s) else s end as start_label,
                         case when s = e then finer else e end as end_label from carried)
            union all
            select hashtag, 6, null, null, 'More Recent', '#000000', '000000.gif'
            from (select distinct hashtag from labelled)
        """,
    }


_SLICED = {
    "slices": _SLICES,
    "sliced": """
        select g.hashtag, timebucket, lat, lng, oldest, newest, slice, colour,
               substr(colour, 2) || '.gif' as icon
        from geo g join ranges r using (hashtag)
        left join slices on timebucket >= oldest + lo * (newest - oldest)::double
                        and timebucket < oldest + hi * (newest - oldest)::double
    """,
}


def _trend(body: str, *more: str) -> str:
    trend = """
        select s.*, l.name as label,
               to_json({'timebucket': timebucket, 'lat': lat, 'lng': lng})::varchar as point
        from sliced s left join legend l on l.hashtag = s.hashtag and l.slice = s.slice
    """
    return _with(
        body, "geo", "ranges", *more, **_SLICED, **_legend_without_slices("ranges"), trend=trend
    )


def _legend_without_slices(ranges: str) -> dict[str, str]:
    parts = _legend_ctes(ranges)
    del parts["slices"]
    return parts


_KEYWORDS = "(" + ", ".join(f"'{word.lower()}'" for word in q.KEYWORDS) + ")"


def _points(bucket: int, parts: int) -> str:
    return _with(
        """
        select hashtag, timebucket, part, count(*) as uses,
               to_json(list(struct_pack(ts := floor(epoch(created_at))::bigint, lat := lat, lng := lng)
                            order by created_at, lat, lng))::varchar as points
        from parted group by hashtag, timebucket, part
        """,
        "uses",
        parted=f"""
            select *, {_bucket_end(bucket)} as timebucket, (id + pos)::bigint % {parts} as part from uses
        """,
    )


def _chunks(most: int) -> str:
    return _with(
        """
        select hashtag, timebucket, part, count(*) as uses,
               to_json(list(struct_pack(ts := floor(epoch(created_at))::bigint, lat := lat, lng := lng)
                            order by created_at, id, pos))::varchar as points
        from numbered group by hashtag, timebucket, part
        """,
        "uses",
        numbered=f"""
            select *, (row_number() over (partition by hashtag, timebucket order by created_at, id, pos) - 1) // {most} as part
            from (select *, {_bucket_end(86400)} as timebucket from uses)
        """,
    )


_SLICE = f"least({REPLAY_SLICES - 1}, greatest(0, floor((epoch(created_at) - {REPLAY_START}) / {REPLAY_SLICE})))::integer"


def _latest_by_day(source: str, order: str) -> str:
    return f"""
        select lower(hashtag) as hashtag, timebucket, lat, lng
        from (select *, {_bucket_end(86400)} as timebucket from {source})
        qualify row_number() over (
            partition by lower(hashtag), timebucket order by {order}) = 1
    """


def _user_list(metric: str, name: str, n: int) -> str:
    return _with(
        f"""select user_handle, item as {name}, count, first_seen, rank
            from item_ranks where metric = '{metric}' and rank <= {n}""",
        "item_ranks",
    )


def _page(source: str) -> str:
    def listed(metric: str, name: str) -> str:
        return f"""coalesce(to_json(list({{'{name}': item, 'count': count}} order by rank)
                            filter (where metric = '{metric}'))::varchar, '[]')"""

    return _with(
        """
        select h.user_handle, avg_retweets as an1, coalesce(an2, '[]') as an2,
               coalesce(an3, '[]') as an3, coalesce(an4, '[]') as an4, coalesce(an5, '[]') as an5,
               followers_count, friends_count as following_count, description, avatar_url
        from handles h left join averages a on a.user_handle = h.user_handle
        left join lists l on l.user_handle = h.user_handle
        left join profiles p on p.user_handle = h.user_handle
        """,
        "item_ranks",
        "averages",
        "profiles",
        handles=source,
        lists=f"""
            select user_handle, {listed('hashtags', 'hashtag')} as an2,
                   {listed('mentions', 'person')} as an3, {listed('replies', 'screen_name')} as an4,
                   {listed('locations', 'location')} as an5
            from item_ranks where rank <= 15 group by user_handle
        """,
    )


_TREND_INFLUENCERS = """
    select hashtag, t.user_handle, count, rank, avatar_url
    from top t left join profiles p on p.user_handle = t.user_handle
"""
_HALF = f"timestamp '{q.FIRST_HALF_ENDS}'"
_WEST, _SOUTH, _EAST, _NORTH = q.BOX


def oracle_sql() -> dict[str, str]:
    sql = {
        "tweets_flat": _with(
            """
            select id, floor(epoch(created_at))::bigint as created_at, text, retweet_count,
                   screen_name, reply_to as in_reply_to_screen_name, pt_lat, pt_lng, place_full_name,
                   original as orig_screen_name,
                   to_json(list_transform(entity_tags, lambda t: {'text': t}))::varchar as hashtags,
                   to_json(list_transform(entity_mentions, lambda m: {'screen_name': m}))::varchar
                       as user_mentions
            from tweets
            """,
            "tweets",
        ),
        "text_hashtags": _with("select id, pos, hashtag, lat, lng from uses", "uses"),
        "geo_points": _with(
            f"""select id, pos, hashtag, lat, lng from live
                where lng between {_WEST} and {_EAST} and lat between {_SOUTH} and {_NORTH}""",
            "live",
        ),
        "geo_points_world": _with(
            """select id, pos, hashtag, lat, lng from live
               where lng between -179.9 and 179.9 and lat between -89.9 and 89.9""",
            "live",
        ),
        "point_rows": _with(
            f"""select hashtag, {_bucket_end(1)} as timebucket, id, pos,
                       floor(epoch(created_at))::bigint as ts, lat, lng from uses""",
            "uses",
        ),
        "profiles": _with(
            """select user_handle, avatar_url, description, followers_count, friends_count
               from profiles""",
            "profiles",
        ),
        "hashtag_points": _points(3600, 8),
        "point_chunks": _chunks(10_000),
        "point_chunks_small": _chunks(7),
        "hashtag_points_split": _points(86400, 25),
        "hashtag_geo_latest": _with("select * from geo", "geo"),
        "ordered_scan": _with("select * from geo order by hashtag, timebucket", "geo"),
        "hashtag_time_range": _with("select * from ranges", "ranges"),
        "hashtag_slices": _with("select * from sliced", "geo", "ranges", **_SLICED),
        "trend_legend": _with("select * from legend", "legend_ranges", **_legend_ctes("legend_ranges")),
        "duration_labels": _with(
            f"""select hashtag, {_label('x')} as auto_label, {_label('x', 'sec')} as sec_label,
                       {_label('x', 'minute')} as minute_label, {_label('x', 'hr')} as hr_label,
                       {_label('x', 'day')} as day_label
                from (select hashtag, (newest - oldest)::double / 7 as x from legend_ranges)""",
            "legend_ranges",
        ),
        "hashtag_trend": _trend(f"select * from trend where hashtag in {_KEYWORDS}"),
        "hashtag_trend_all": _trend("select * from trend"),
        "hashtag_legend": _with("select * from legend", "ranges", **_legend_ctes("ranges")),
        "trend_json": _trend(
            f"""select to_json({{'hashtag': hashtag, 'timebucket': timebucket, 'lat': lat,
                                'lng': lng, 'colour': colour}})::varchar as json
                from trend where hashtag in {_KEYWORDS}"""
        ),
        "keyword_status": _with(
            """
            select k.hashtag, count(g.hashtag) as rows, count(g.hashtag) > 0 as has_data
            from keywords k left join geo g on g.hashtag = k.hashtag group by k.hashtag
            """,
            "geo",
            keywords="select * from (values "
            + ", ".join(f"('{word.lower()}')" for word in q.KEYWORDS)
            + ") as k(hashtag)",
        ),
        "hashtag_trend_table": _trend(
            "select * from trend where hashtag in (select lower(event_type) from events)"
        ),
        "keyword_status_table": _with(
            """
            select k.hashtag, count(g.hashtag) as rows, count(g.hashtag) > 0 as has_data
            from keywords k left join geo g on g.hashtag = k.hashtag group by k.hashtag
            """,
            "geo",
            keywords="""select lower(n_name) as hashtag from nation
                        union select lower(event_type) from events""",
        ),
        "lookup_hashtag": _with(
            """
            select * from geo where hashtag in (
                select lower(n_name) from nation union select lower(event_type) from events)
            """,
            "geo",
        ),
        "trend_map": _trend(
            f"""
            select hashtag, timebucket, lat, lng, slice, colour, label from trend
            where hashtag in {_KEYWORDS}
            union all
            select hashtag, null, lat, lng, 6, '#000000', 'More Recent' from live
            where hashtag in {_KEYWORDS}
            """,
            "live",
        ),
        "put_geo": _with(
            """
            select * from stored
            union all
            select * from everything e where not exists (
                select 1 from stored s
                where s.hashtag = e.hashtag and s.timebucket = e.timebucket)
            """,
            "uses",
            early=f"select * from uses where created_at < {_HALF}",
            stored=_latest_by_day("early", "created_at desc, id desc, pos desc"),
            everything=_latest_by_day("uses", "created_at desc, id desc, pos desc"),
        ),
        "retweet_counts": _with(
            f"""select {_bucket_end(900)} as timebucket, hashtag, user_handle, count(*) as count
                from reshares group by all""",
            "reshares",
        ),
        "running_influencers": _with("select * from totals", "totals"),
        "accumulate_counts": _with("select * from totals", "totals"),
        "count_batches": _with("select * from totals", "totals"),
        "stream_compact_continue": _with("select * from totals", "totals"),
        "distinct_retweeters": _with(
            """select lower(hashtag) as hashtag, user_handle, count(distinct reshared_by) as people
               from reshares group by lower(hashtag), user_handle""",
            "reshares",
        ),
        "top_influencers": _with("select * from top", "top"),
        "trend_influencers": _with(_TREND_INFLUENCERS, "top", "profiles"),
        "trend_influencers_keywords": _with(
            f"{_TREND_INFLUENCERS} where hashtag in {_KEYWORDS}", "top", "profiles"
        ),
        "lookup_hashtag_user": _with(
            f"""
            select * from totals t where exists (
                select 1 from reshares r where lower(r.hashtag) = t.hashtag
                and r.user_handle = t.user_handle and r.created_at >= {_HALF})
            """,
            "totals",
        ),
        "timeline": _with(
            """select user_handle, id, rn::integer as rn,
                      (floor((rn - 1) / 10) + 1)::integer as page
               from ranked where rn <= 30""",
            "ranked",
        ),
        "user_avg_retweets": _with("select * from averages", "averages"),
        "user_item_counts": _with("select * from item_counts", "item_counts"),
        "user_shares": _with(
            """
            select *, printf('%.1f', share_pct) as share_label
            from (select *, count / sum(count) over (partition by user_handle, metric) * 100
                         as share_pct from item_ranks where rank <= 15)
            """,
            "item_ranks",
        ),
        "user_page": _page("select distinct user_handle from timeline"),
        "user_page_handles": _page(
            "select * from (values "
            + ", ".join(f"('{h.lower().removeprefix('@')}')" for h in q.HANDLES)
            + ") as h(user_handle)"
        ),
        "stream_geo": _with("select * from geo", "geo"),
        "stream_put_once": _with("select * from geo", "geo"),
        "stream_influencers": _with(
            f"""
            select hashtag, user_handle, timebucket, count(*) as count
            from (select *, {_bucket_end(900)} as timebucket from reshares)
            group by all
            """,
            "reshares",
        ),
        "stream_influencers_late": _with(
            f"""
            select hashtag, user_handle, timebucket, count(*) as count
            from (select *, {_bucket_end(900)} as timebucket from reshares where {_SLICE} > 0)
            group by all
            """,
            "reshares",
        ),
        "stream_replay_put": _with(
            _latest_by_day("first_arrivals", "created_at desc, id desc, pos desc"),
            "uses",
            first_arrivals=f"""
                select id, created_at, pos, hashtag, lat, lng
                from (select *, {_bucket_end(86400)} as day, xor({_SLICE}, 1) as arrived from uses)
                qualify arrived = min(arrived) over (partition by lower(hashtag), day)
            """,
        ),
        "stream_people": _with("select hashtag, user_handle, true as within from totals", "totals"),
        "stream_running": _with("select * from totals", "totals"),
        "stream_accumulate": _with("select * from totals", "totals"),
        "stream_live": _with("select hashtag, lat, lng, id, pos from live", "live"),
        "stream_live_messages": _with(
            """select hashtag as key, to_json({'lat': lat, 'lng': lng})::varchar as value
               from live where hashtag = 'click'""",
            "live",
        ),
        "backfill_geo": _with(
            f"""select lower(hashtag) as hashtag, {_bucket_end(86400)} as timebucket,
                       floor(epoch(created_at))::bigint as ts, lat, lng from uses""",
            "uses",
        ),
        "backfill_geo_latest": _with(
            _latest_by_day("uses", "floor(epoch(created_at)) desc, lat desc, lng desc"), "uses"
        ),
        # The tag of a line ends at its first comma. Of a tag with a line break, the old line
        # reader sees only the second line, and takes its first two characters for the marks.
        "backfill_influencers": _with(
            f"""
            select lower(case when contains(hashtag, chr(10))
                              then substr(split_part(split_part(hashtag, chr(10), 2), ',', 1), 3)
                              else split_part(hashtag, ',', 1) end) as hashtag,
                   timebucket, user_handle, count
            from (select {_bucket_end(86400)} as timebucket, hashtag, user_handle, count(*) as count
                  from reshares group by all)
            """,
            "reshares",
        ),
    }
    names = {"hashtags": "hashtag", "mentions": "person", "replies": "screen_name", "locations": "location"}
    for metric, name in names.items():
        sql[f"user_{metric}"] = _user_list(metric, name, 15)
        sql[f"user_{metric}_top3"] = _user_list(metric, name, 3)
    # Other ways to the same rows.
    same = {
        "read_tweets_json": "tweets_flat",
        "decode_tweets": "tweets_flat",
        "stream_tweets_json": "tweets_flat",
        "read_profiles": "profiles",
        "stream_put_geo": "put_geo",
        "put_geo_two_writers": "put_geo",
        "stream_geo_window": "stream_geo",
        "stream_influencers_window": "stream_influencers",
        "stream_replay_counts": "stream_running",
        "stream_replay_running": "stream_running",
        "timeline_pages": "timeline",
        "put_geo_compacted": "put_geo",
        "stream_trend_map": "trend_map",
    }
    sql |= {name: sql[other] for name, other in same.items()}
    return sql
