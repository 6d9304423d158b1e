"""DuckDB SQL that says the same as the queries, from shared pieces."""

#: pages with canonical_url, host_dir and item_id.
CAPTURES = r"""
b AS (SELECT page_id, url, html, regexp_replace(trim(url), '#.*$', '', 's') AS bare FROM pages),
u AS (SELECT *, lower(regexp_extract(bare, '^([A-Za-z][A-Za-z0-9+.-]*):', 1)) AS scheme,
  rtrim(lower(regexp_replace(regexp_replace(regexp_extract(bare, '^[A-Za-z][A-Za-z0-9+.-]*://([^/?#]*)', 1), '^.*@', ''), ':[0-9]*$', '')), '.') AS h0,
  regexp_extract(bare, '^[A-Za-z][A-Za-z0-9+.-]*://[^/?]*([^?]*)', 1) AS path0, regexp_extract(bare, '\?(.*)$', 1, 's') AS query0 FROM b),
v AS (SELECT *, CASE WHEN contains(regexp_replace(h0, '^(www\.)+', ''), '.') THEN regexp_replace(h0, '^(www\.)+', '') ELSE h0 END AS host,
  list_filter(list_transform(string_split(query0, '&'), lambda x: regexp_replace(x, '^(?i:amp(;|%3b))+', '')), lambda x: x <> '' AND NOT (lower(split_part(x, '=', 1)) LIKE 'utm\_%' ESCAPE '\' OR lower(split_part(x, '=', 1)) IN ('fbclid', 'gclid', 'dclid', 'msclkid', 'twclid', 'igshid', 'mc_cid', 'mc_eid'))) AS params FROM u),
w AS (SELECT *, array_to_string(list_transform(list_sort(list_transform(params, lambda x, i: {'n': split_part(x, '=', 1), 'i': i, 't': x})), lambda s: s.t), '&') AS query FROM v),
c AS (SELECT page_id, url, html, host AS host_dir, scheme || '://' || host || (CASE WHEN path0 = '' THEN '/' ELSE path0 END) || (CASE WHEN query = '' THEN '' ELSE '?' || query END) AS canonical_url,
  TIMESTAMP '2024-01-01 00:00:00' + to_minutes(page_id) AS fetched_at, query0, query, len(string_split(query0, '&')) - len(params) - (query0 = '')::INT AS n_dropped FROM w),
cap AS (SELECT *, sha256(canonical_url) AS item_id, sha256(html) AS body_sha, strlen(html) AS byte_len FROM c)
"""

#: Links of each page in order: place, href as written, and the resolved address.
LINKS = CAPTURES + r""",
h AS (SELECT page_id, canonical_url, url, unnest(regexp_extract_all(html, '<a href="([^"]*)"', 1)) AS href, generate_subscripts(regexp_extract_all(html, '<a href="([^"]*)"', 1), 1) AS place FROM cap),
links AS (SELECT page_id, canonical_url, place, href, regexp_extract(url, '^([A-Za-z]+://[^/?#]*)', 1) || (CASE WHEN href = '/.' THEN '/' ELSE replace(replace(url_encode(href), '%2F', '/'), '%2C', ',') END) AS link FROM h)
"""


def over(ctes: str, select: str) -> str:
    return f"WITH {ctes.strip()}\n{select}"
