"""URL identity as native columns, for addresses that are already plain ASCII; `urlspec` has the general form."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Query parameters that only track, besides those that start with utm_.
TRACKING = ("fbclid", "gclid", "dclid", "msclkid", "twclid", "igshid", "mc_cid", "mc_eid")
#: A leading escaped ampersand, undone again and again.
ESCAPED_AMPERSAND = r"\A(?i:amp(;|%3b))+"


def scheme_of(url: Column) -> Column:
    return F.lower(F.regexp_extract(url, r"\A([A-Za-z][A-Za-z0-9+.-]*):", 1))


def authority_of(url: Column) -> Column:
    return F.regexp_extract(url, r"\A[A-Za-z][A-Za-z0-9+.-]*://([^/?#]*)", 1)


def rewritten_host(host: Column) -> Column:
    """Trailing dots go; leading www. goes as long as what is left has a dot."""
    return F.regexp_replace(F.regexp_replace(F.lower(host), r"\.+\z", ""), r"\A(www\.)+(?=.*\.)", "")


def host_of(url: Column) -> Column:
    """The host as written, lower-cased, without user, password and port."""
    return F.lower(F.regexp_replace(F.regexp_replace(authority_of(url), r"\A.*@", ""), r":[0-9]*\z", ""))


def host_dir(host: Column) -> Column:
    """The directory of a host; null if it isn't safe as a name."""
    name = F.replace(F.regexp_replace(F.lower(host), r"[\[\]]", ""), F.lit(":"), F.lit("-"))
    return F.when(name.rlike(r"\A[a-z0-9_-][a-z0-9._-]*\z"), name)


def parameter_name(parameter: Column) -> Column:
    return F.substring_index(parameter, "=", 1)


def is_tracking(name: Column) -> Column:
    return F.lower(name).startswith("utm_") | F.lower(name).isin(*TRACKING)


def undo_escaped_ampersand(parameter: Column) -> Column:
    return F.regexp_replace(parameter, ESCAPED_AMPERSAND, "")


def kept_query(query: Column) -> Column:
    """Parameters without tracking ones, in stable order of their names; empty if none is left."""
    parts = F.filter(F.transform(F.split(query, "&"), undo_escaped_ampersand), lambda p: (p != "") & ~is_tracking(parameter_name(p)))
    keyed = F.array_sort(F.transform(parts, lambda p, i: F.struct(parameter_name(p).alias("name"), i.alias("place"), p.alias("text"))))
    return F.array_join(F.transform(keyed, lambda p: p["text"]), "&")


def canonical_url(url: Column) -> Column:
    """The address under which a page is filed; null unless http(s) with a host."""
    bare = F.regexp_replace(F.trim(url), r"#[\s\S]*\z", "")
    scheme = scheme_of(bare)
    port = F.regexp_extract(authority_of(bare), r":([0-9]+)\z", 1)
    default = F.when(scheme == "http", "80").otherwise("443")
    host = rewritten_host(host_of(bare))
    path = F.regexp_extract(bare, r"\A[A-Za-z][A-Za-z0-9+.-]*://[^/?]*([^?]*)", 1)
    query = kept_query(F.regexp_extract(bare, r"\?([\s\S]*)\z", 1))
    whole = F.concat(scheme, F.lit("://"), host, F.when((port == "") | (port == default), "").otherwise(F.concat(F.lit(":"), port)), F.when(path == "", "/").otherwise(path), F.when(query == "", "").otherwise(F.concat(F.lit("?"), query)))
    return F.when(scheme.isin("http", "https") & host_dir(host).isNotNull(), whole)
