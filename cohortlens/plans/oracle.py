"""DuckDB SQL for the correctness oracle.

The driver pre-registers the base tables as views; each oracle query names the
fixture views (``posts``, ``replies`` …) and shared helper relations it needs,
and :func:`with_ctes` prepends exactly those definitions as a ``WITH`` list.
"""

from __future__ import annotations

import re

# fixture views of FIXTURES.md, DuckDB dialect (definition order = dependency order)
CTES: dict[str, str] = {
    "post_counts": "select l_orderkey, count(*) num_comments from lineitem group by l_orderkey",
    "posts": """
select cast(o_orderkey as varchar) id,
  case when o_orderkey % 50 = 0 then '[deleted]' when o_orderkey % 51 = 0 then null
       else concat('u', cast(o_custkey as varchar)) end author,
  cast(floor(epoch(o_orderdate)) as bigint) created_utc, cast(o_orderdate as date) created_day,
  strftime(o_orderdate, '%Y-%m') as month,
  concat(o_orderpriority, '/', o_orderstatus) community,
  cast(floor(o_totalprice/50000) as bigint) score,
  cast(coalesce(num_comments, 0) as bigint) num_comments,
  case when o_orderkey % 13 = 0 then null
       else round(cast(o_orderkey % 101 as double)/100, 2) end sentiment_complex
from orders left join post_counts on o_orderkey = l_orderkey""",
    "replies": """
select cast(l_orderkey as varchar) link_id,
  concat(cast(l_orderkey as varchar), ':', cast(l_suppkey % 5 as varchar)) parent_id,
  case when l_linenumber = 7 then concat('s', cast(l_suppkey as varchar))
       else concat('u', cast(o_custkey as varchar)) end author,
  concat('s', cast(l_suppkey as varchar)) partner,
  cast(floor(epoch(l_shipdate)) as bigint) created_utc, cast(l_shipdate as date) created_day,
  strftime(l_shipdate, '%Y-%m') as month,
  concat(o_orderpriority, '/', o_orderstatus) community,
  cast(floor(l_quantity/10) as bigint) score, l_linestatus = 'O' is_submitter,
  case when l_partkey % 17 = 0 then null
       else round(cast(l_partkey % 97 as double)/96, 2) end sentiment
from lineitem join orders on l_orderkey = o_orderkey""",
    "ev": """
select cast(event_id as varchar) id, concat('u', cast(user_id as varchar)) author,
  cast(floor(epoch(ts)) as bigint) created_utc, cast(ts as date) created_day,
  strftime(ts, '%Y-%m') as month, event_type community,
  cast(floor(value/10) as bigint) score, json_extract_string(props, '$.k') parent_id
from events""",
    "docs": """
select doc_id id, source author, lang community,
  split_part(text, chr(10), 1) title, substr(text, length(split_part(text, chr(10), 1)) + 2) selftext
from documents
union all
select -doc_id - 1 id, source author, lang community, split_part(text, chr(10), 1) title, '[removed]' selftext
from documents where doc_id % 37 = 0""",
    "turns": """
select concat(cast(conv_id as varchar), ':', cast(turn as varchar)) id, cast(conv_id as varchar) link_id,
  case when turn > 0 then concat(cast(conv_id as varchar), ':', cast(turn - 1 as varchar)) end parent_id,
  role author, text body, role = 'user' is_submitter
from conversations""",
    # community groups of the fixtures (MH tested first)
    "tposts": """
select *, case when community in ('1-URGENT/O', '2-HIGH/F') then 'MH'
               when community = '1-URGENT/F' then 'SW' else 'Otr' end community_grp
from posts""",
    "treplies": """
select *, case when community in ('1-URGENT/O', '2-HIGH/F') then 'MH'
               when community = '1-URGENT/F' then 'SW' else 'Otr' end community_grp
from replies""",
    "tev": """
select *, case when community = 'purchase' then 'MH' when community = 'error' then 'SW'
               else 'Otr' end community_grp
from ev""",
    # Cohort by priority SW > MH > Otr over all of a user's rows (null author = one user)
    "cohorts": """
select author, case max(case community_grp when 'SW' then 2 when 'MH' then 1 else 0 end)
                 when 2 then 'SW' when 1 then 'MH' else 'Otr' end cohort
from (select author, community_grp from tposts union all select author, community_grp from treplies) u
group by author""",
    # Inner lookup of the cohort (null author never matches)
    "cposts": "select p.*, c.cohort from tposts p join cohorts c on p.author = c.author",
    "creplies": "select r.*, c.cohort from treplies r join cohorts c on r.author = c.author",
    # all texts of both kinds, with the tags of the post that the document or conversation number names
    "xtexts": """
select t.id, t.kind, t.title, t.selftext, coalesce(p.community_grp, 'Otr') community_grp,
       coalesce(c.cohort, 'Otr') cohort, coalesce(p.created_day, date '1995-01-01') created_day
from (select cast(id as varchar) id, cast(id as varchar) link_id, 'post' kind, title, selftext from docs
      union all select id, link_id, 'reply' kind, null title, body selftext from turns) t
left join tposts p on p.id = t.link_id left join cohorts c on c.author = p.author""",
}

_WORD = re.compile(r"[A-Za-z_][A-Za-z0-9_]*")


def _needed(sql: str) -> list[str]:
    seen: list[str] = []

    def visit(text: str) -> None:
        words = set(_WORD.findall(text))
        for name in CTES:
            if name in words and name not in seen:
                visit(CTES[name])
                if name not in seen:
                    seen.append(name)

    visit(sql)
    order = list(CTES)
    return sorted(seen, key=order.index)


def with_ctes(sql: str) -> str:
    """Prefix ``sql`` with the fixture/helper CTEs it references."""
    body = sql.strip()
    names = _needed(body)
    if not names:
        return body
    defs = ",\n".join(f"{n} as ({CTES[n].strip()})" for n in names)
    if body[:15].lower() == "with recursive ":
        return f"with recursive {defs},\n{body[15:]}"
    if body[:5].lower() == "with ":
        return f"with {defs},\n{body[5:]}"
    return f"with {defs}\n{body}"
