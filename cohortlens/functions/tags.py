"""Row tags: community group (F3), zero-score rules (F15), safe score parse (F16)."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from ..params import Groups


def community_group(community: Column | str, groups: Groups) -> Column:
    """MH list first, then SW, default other; case-sensitive; null -> other."""
    c = F.col(community) if isinstance(community, str) else community
    return (F.when(c.isin(list(groups.mh)), F.lit(groups.mh_label))
            .when(c.isin(list(groups.sw)), F.lit(groups.sw_label))
            .otherwise(F.lit(groups.other_label)))


def group_priority(group: Column | str, groups: Groups) -> Column:
    """A7 helper: SW=2, MH=1, other=0 (max over a user's rows gives the cohort)."""
    g = F.col(group) if isinstance(group, str) else group
    return (F.when(g == groups.sw_label, F.lit(2)).when(g == groups.mh_label, F.lit(1))
            .otherwise(F.lit(0)))


def priority_label(p: Column | str, groups: Groups) -> Column:
    p = F.col(p) if isinstance(p, str) else p
    return (F.when(p == 2, F.lit(groups.sw_label)).when(p == 1, F.lit(groups.mh_label))
            .otherwise(F.lit(groups.other_label)))


def zero_rule(score: Column, kind: Column, rule: str = "write", *, is_submitter: Column | None = None,
              num_comments: Column | None = None, zero_reply: float = 2.0,
              zero_post: float = -0.5) -> Column:
    """replace a zero score.

    ``write``  (scores that are stored): reply 0 -> ``zero_reply``, post 0 -> ``zero_post``.
    ``report`` (the per-user month matrix): reply 0 -> -1 if the author is the
    thread submitter else +1; post 0 -> -1 without comments else +1.
    """
    s = score.cast("double")
    if rule == "write":
        adj = F.when(kind == "reply", F.lit(zero_reply)).otherwise(F.lit(zero_post))
    elif rule == "report":
        sub = F.coalesce(is_submitter, F.lit(False)) if is_submitter is not None else F.lit(False)
        nc = F.coalesce(num_comments, F.lit(0)) if num_comments is not None else F.lit(0)
        # reply: +1 unless the author submitted the thread; post: +1 if it drew comments
        adj = F.when(kind == "reply", F.when(sub, F.lit(-1.0)).otherwise(F.lit(1.0))) \
               .otherwise(F.when(nc == 0, F.lit(-1.0)).otherwise(F.lit(1.0)))
    else:
        raise ValueError(f"unknown zero rule {rule!r}")
    return F.when(s == 0, adj).otherwise(s)


def safe_bigint(c: Column, default: int | None = None) -> Column:
    """Parse to BIGINT; unparsable -> null (ANSI-safe ``try_cast``)."""
    src = c.cast("string")
    if default is not None:
        src = F.coalesce(src, F.lit(str(default)))
    return src.try_cast("bigint")


def safe_double(c: Column) -> Column:
    return c.cast("string").try_cast("double")


def cell_code(day: str, cohort: str, grp: str, groups: Groups) -> Column:
    """One long for a day, a cohort and a community group, both of ``groups``' labels."""
    labels = F.array(*[F.lit(x) for x in groups.labels])
    n = len(groups.labels)
    at = [F.array_position(labels, F.col(c)) - 1 for c in (cohort, grp)]
    return F.unix_date(F.col(day)).cast("long") * (n * n) + at[0] * n + at[1]


def cell_parts(code: str, groups: Groups) -> tuple[Column, Column, Column]:
    """(day, cohort, community group) of a :func:`cell_code`."""
    labels = F.array(*[F.lit(x) for x in groups.labels])
    n = len(groups.labels)
    inner = F.pmod(F.col(code), F.lit(n * n)).cast("int")
    day = F.floor((F.col(code) - inner) / F.lit(n * n)).cast("int")
    return F.date_from_unix_date(day), F.get(labels, F.floor(inner / F.lit(n)).cast("int")), F.get(labels, F.pmod(inner, F.lit(n)))
