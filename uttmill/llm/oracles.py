"""SQL for the operators that SQL can express, in DuckDB's dialect over the same tables."""

WORD = r"[^\x20\x09-\x0D]+"

SUBSTRING_DEDUP = f"""
WITH d AS (SELECT row_number() OVER () AS rid, doc_id, regexp_extract_all(coalesce(text, ''), '{WORD}') AS ws FROM documents),
win AS (SELECT rid, i, md5(array_to_string(ws[i:i+34], ' ')) AS g FROM d, unnest(range(1, len(ws) - 33)) AS t(i)),
rep AS (SELECT rid, i FROM win WHERE g IN (SELECT g FROM win GROUP BY g HAVING count(*) > 1)),
cov AS (SELECT DISTINCT rid, p FROM rep, unnest(range(i, i + 35)) AS t(p)),
word AS (SELECT rid, unnest(ws) AS w, unnest(range(1, len(ws) + 1)) AS p FROM d),
kept AS (SELECT rid, string_agg(w, ' ' ORDER BY p) AS kept, count(*) AS n FROM word ANTI JOIN cov USING (rid, p) GROUP BY rid)
SELECT doc_id, len(ws)::BIGINT AS n_words, (len(ws) - coalesce(n, 0))::BIGINT AS n_removed,
  sha256(coalesce(kept, '')) AS kept_sha256
FROM d LEFT JOIN kept USING (rid)
"""

SUFFIX_DEDUP = """
WITH d AS (SELECT row_number() OVER (ORDER BY doc_id, text) AS rid, doc_id, hex(encode(coalesce(text, ''))) AS h FROM documents),
part AS (SELECT rid, k, substr(h, 2000 * k + 1, 2198) AS h FROM d, unnest(range(0, (length(h) // 2 + 900) // 1000)) AS t(k)),
win AS (SELECT rid, 1000 * k + j AS i, md5(substr(h, 2 * j + 1, 200)) AS g FROM part, unnest(range(0, length(h) // 2 - 99)) AS t(j)),
late AS (SELECT rid, i FROM (SELECT rid, i, row_number() OVER (PARTITION BY g ORDER BY rid, i) AS n FROM win) WHERE n > 1),
edge AS (SELECT rid, i, max(i) OVER (PARTITION BY rid ORDER BY i ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) + 100 AS far FROM late),
mark AS (SELECT rid, i, sum(CASE WHEN far IS NULL OR i > far THEN 1 ELSE 0 END) OVER (PARTITION BY rid ORDER BY i) AS span FROM edge),
span AS (SELECT rid, span, min(i) AS s, max(i) + 100 AS e FROM mark GROUP BY rid, span),
gap AS (SELECT rid, s, e, coalesce(lag(e) OVER (PARTITION BY rid ORDER BY s), 0) AS from_byte FROM span),
cut AS (SELECT rid, count(*) AS n_spans, sum(e - s) AS n_removed, max(e) AS tail,
  string_agg(substr(h, 2 * from_byte + 1, 2 * (s - from_byte)), '' ORDER BY s) AS head FROM gap JOIN d USING (rid) GROUP BY rid)
SELECT doc_id, (length(h) // 2)::BIGINT AS n_bytes, coalesce(n_removed, 0)::BIGINT AS n_removed, coalesce(n_spans, 0)::BIGINT AS n_spans,
  sha256(unhex(CASE WHEN tail IS NULL THEN h ELSE head || substr(h, 2 * tail + 1) END)) AS kept_sha256
FROM d LEFT JOIN cut USING (rid)
"""

# kind, pattern, least length, group of that length
_SECRETS = (
    ("assign", r"""(?i)(?:password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", 6, 1),
    ("access", r"AKIA[A-Z0-9]+", 20, 0),
    ("hex", r"[0-9a-f]+", 24, 0),
    ("pem", r"-----BEGIN (?:[A-Z]+ )*PRIVATE KEY-----", 1, 0),
    ("github", r"gh[pousr]_[A-Za-z0-9]+", 40, 0),
    ("slack", r"xox[abprs]-[A-Za-z0-9-]+", 15, 0),
    ("jwt", r"eyJ[A-Za-z0-9_-]+\.eyJ[A-Za-z0-9_-]+\.[A-Za-z0-9_-]+", 40, 0),
    ("google", r"AIza[A-Za-z0-9_-]+", 39, 0),
)


def _secret_kind(place: int, kind: str, pattern: str, least: int, group: int) -> str:
    """Matches of one kind: what stands between them gives their offsets."""
    p = pattern.replace("'", "''")
    return f"""SELECT rid, {place} AS kind, '{kind}' AS name,
  list_sum(list_transform(between[1:i], lambda x: length(x))) + coalesce(list_sum(list_transform(found[1:i-1], lambda x: length(x))), 0) AS s, length(found[i]) AS n
  FROM (SELECT rid, regexp_split_to_array(text, '{p}') AS between, regexp_extract_all(text, '{p}') AS found, regexp_extract_all(text, '{p}', {group}) AS part
    FROM d WHERE regexp_matches(text, '{p}')), unnest(range(1, len(found) + 1)) AS t(i) WHERE length(part[i]) >= {least}"""


SECRETS = f"""
WITH d AS (SELECT row_number() OVER () AS rid, doc_id, coalesce(text, '') AS text FROM documents),
f AS ({" UNION ALL ".join(_secret_kind(i, *rule) for i, rule in enumerate(_SECRETS))}),
s AS (SELECT rid, kind, name, s::BIGINT AS s, name || ':' || s::BIGINT || ':' || (s + n)::BIGINT AS span FROM f),
a AS (SELECT rid, count(*) FILTER (kind = 0) AS n_assign, count(*) FILTER (kind = 1) AS n_access, count(*) FILTER (kind = 2) AS n_hex,
  string_agg(span, ',' ORDER BY s, kind) FILTER (kind < 3) AS base, string_agg(span, ',' ORDER BY s, kind) AS spans FROM s GROUP BY rid)
SELECT doc_id, coalesce(n_assign, 0)::BIGINT AS n_assign, coalesce(n_access, 0)::BIGINT AS n_access, coalesce(n_hex, 0)::BIGINT AS n_hex,
  sha256(coalesce(base, '')) AS base_sha256, coalesce(spans, '') AS spans FROM d LEFT JOIN a USING (rid)
"""


MIXING = f"""
WITH d AS (SELECT row_number() OVER () AS rid, doc_id, source IS NULL AS none, coalesce(source, '') AS source, coalesce(text, '') AS text FROM documents),
e AS (SELECT rid, doc_id, none, source, len(regexp_extract_all(text, '{WORD}'))::BIGINT AS size, md5(text) AS tie,
  length(translate(text, '#*$%&|<>!', ''))::DOUBLE / greatest(length(text), 1) AS share,
  (('0x' || substr(md5(concat_ws('|', '8', doc_id::VARCHAR)), 1, 13))::BIGINT + 1)::DOUBLE / 4503599627370496.0::DOUBLE AS u FROM d),
f AS (SELECT *, -ln(u) / greatest(0.05::DOUBLE, share * share * share * share) AS key FROM e),
s AS (SELECT none, source, sum(size)::BIGINT AS source_size FROM f GROUP BY none, source),
w AS (SELECT *, 3.0::DOUBLE * source_size AS cap, CASE (row_number() OVER (ORDER BY none, source) - 1) % 3 WHEN 0 THEN 5 WHEN 1 THEN 2 ELSE 1 END::DOUBLE AS weight FROM s),
l AS (SELECT *, (sum(source_size) OVER ()::DOUBLE - coalesce(sum(cap) OVER (ORDER BY cap / weight, none, source ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0))
  / sum(weight) OVER (ORDER BY cap / weight, none, source ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS level FROM w),
t AS (SELECT *, max(level) OVER () AS top FROM l),
p AS (SELECT none, source, source_size, CASE WHEN cap / weight <= top THEN cap ELSE top * weight END AS target FROM t),
q AS (SELECT *, CASE WHEN source_size > 0 THEN floor(target / source_size) ELSE 0 END::BIGINT AS epochs FROM p),
o AS (SELECT f.doc_id, size, source_size, target, epochs, target - epochs * source_size AS budget,
  sum(size) OVER (PARTITION BY none, source ORDER BY key, doc_id NULLS FIRST, tie ROWS UNBOUNDED PRECEDING) AS upto FROM f JOIN q USING (none, source))
SELECT doc_id, size, source_size, target,
  (size * (epochs + CASE WHEN size > 0 AND (upto <= budget OR (upto - size < budget AND 2 * (budget - (upto - size)) > size)) THEN 1 ELSE 0 END))::BIGINT AS taken
FROM o
"""


def _field(value: str) -> str:
    return f"coalesce(strlen({value}::VARCHAR) || ':' || {value}::VARCHAR, '-')"


def _leaf(text: str) -> str:
    return "sha256(" + " || ".join(map(_field, ("doc_id", "source", "lang", "n_chars", text))) + ")"


def _tree(name: str, leaves: str) -> str:
    """Nodes of the trees over ``leaves`` (tree, pos, size, digest), and what stands beside each."""
    beside = "(PARTITION BY tree, lvl, pos // 3 ORDER BY pos ROWS BETWEEN"
    return f"""{name} AS (SELECT tree, 0 AS lvl, pos, size, digest FROM {leaves}
  UNION ALL SELECT tree, lvl + 1, pos // 3, any_value((size + 2) // 3), sha256(string_agg(digest, '' ORDER BY pos)) FROM {name} WHERE size > 1 GROUP BY tree, lvl, pos // 3),
{name}_side AS (SELECT tree, lvl, pos, coalesce(string_agg(digest, '') OVER {beside} UNBOUNDED PRECEDING AND 1 PRECEDING), '') AS before,
  coalesce(string_agg(digest, '') OVER {beside} 1 FOLLOWING AND UNBOUNDED FOLLOWING), '') AS after FROM {name} WHERE size > 1)"""


# CRC-32 of the decimal id, bit by bit
_BIT = "CASE WHEN j % 8 = 0 THEN xor(a, ascii(substr(doc_id::VARCHAR, j // 8 + 1, 1))::BIGINT) ELSE a END"
_CRC = f"list_reduce(range(0, 8 * strlen(doc_id::VARCHAR)), lambda a, j: xor(({_BIT}) >> 1, 3988292384 * (({_BIT}) & 1)), 4294967295::BIGINT)"

MERKLE = f"""
WITH RECURSIVE d AS (SELECT row_number() OVER () AS rid, doc_id, coalesce('=' || source, '') AS tree, {_leaf("text")} AS leaf,
  CASE WHEN ({_CRC} & 1) = 1 THEN {_leaf("replace(text, chr(10), '')")} ELSE {_leaf("text")} END AS found_leaf FROM documents),
l AS (SELECT *, row_number() OVER (PARTITION BY tree ORDER BY doc_id NULLS FIRST, leaf, found_leaf) - 1 AS pos, count(*) OVER (PARTITION BY tree) AS size, leaf AS digest FROM d),
{_tree("node", "l")},
sub AS (SELECT tree AS grp, digest FROM node WHERE size = 1),
g AS (SELECT '' AS tree, grp, row_number() OVER (ORDER BY grp) - 1 AS pos, count(*) OVER () AS size, digest FROM sub),
{_tree("top", "g")},
walk AS (SELECT rid, tree, 0 AS lvl, pos, '' AS proof, found_leaf AS fold FROM l
  UNION ALL SELECT rid, w.tree, w.lvl + 1, w.pos // 3, proof || before || after, sha256(before || fold || after) FROM walk w JOIN node_side s ON w.tree = s.tree AND w.lvl = s.lvl AND w.pos = s.pos),
arrived AS (SELECT rid, tree, arg_max(proof, lvl) AS proof, arg_max(fold, lvl) AS fold FROM walk GROUP BY rid, tree),
climb AS (SELECT rid, 0 AS lvl, g.pos, proof, fold FROM arrived a JOIN g ON a.tree = g.grp
  UNION ALL SELECT rid, w.lvl + 1, w.pos // 3, proof || before || after, sha256(before || fold || after) FROM climb w JOIN top_side s ON w.lvl = s.lvl AND w.pos = s.pos),
ended AS (SELECT rid, arg_max(proof, lvl) AS proof, arg_max(fold, lvl) AS fold FROM climb GROUP BY rid),
root AS (SELECT digest AS root FROM top WHERE size = 1)
SELECT doc_id, leaf, g.digest AS subroot, root, sha256(proof) AS proof_sha256, fold AS folded_root, fold = root AS verified
FROM l JOIN g ON l.tree = g.grp JOIN ended USING (rid), root
"""


_UPPER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
COLLOCATIONS = rf"""
WITH p AS (SELECT coalesce(lang, 'und') AS lang, unnest(regexp_split_to_array(translate(coalesce(text, ''), '{_UPPER}', '{_UPPER.lower()}'), '[.,;:!?\x0A-\x0D]')) AS piece FROM documents),
w AS (SELECT lang, regexp_extract_all(piece, '[^\x20\x09]+') AS ws FROM p),
g AS (SELECT lang, k, array_to_string(ws[i:i+k-1], ' ') AS phrase FROM w, unnest([1, 2, 3, 4]) AS t(k), unnest(range(1, len(ws) - k + 2)) AS u(i)),
f AS (SELECT lang, k, phrase, count(*)::BIGINT AS a FROM g GROUP BY lang, k, phrase),
n AS (SELECT lang, sum(a)::BIGINT AS n FROM f WHERE k = 1 GROUP BY lang),
c AS (SELECT lang, k AS len, phrase, string_split(phrase, ' ') AS ws, a FROM f WHERE k > 1 AND a >= 30),
cut AS (SELECT c.*, cut, l.a AS l, r.a AS r, ((2000000::HUGEINT * c.a) // (l.a + r.a))::BIGINT AS score FROM c, unnest(range(1, len)) AS t(cut)
  JOIN f l ON l.lang = c.lang AND l.phrase = array_to_string(ws[1:cut], ' ') JOIN f r ON r.lang = c.lang AND r.phrase = array_to_string(ws[cut+1:], ' ')),
low AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY lang, phrase ORDER BY score, cut) AS best FROM cut) WHERE best = 1),
part AS (SELECT lang, array_to_string(ws[i:i+m-1], ' ') AS phrase, max(a) AS longer FROM c, unnest([2, 3]) AS t(m), unnest(range(1, len - m + 2)) AS u(i) WHERE m < len GROUP BY ALL),
kept AS (SELECT low.* FROM low LEFT JOIN part USING (lang, phrase) WHERE longer IS NULL OR 100::HUGEINT * longer < 80::HUGEINT * a),
o AS (SELECT *, row_number() OVER (PARTITION BY lang ORDER BY score DESC, a DESC, phrase) AS rank FROM kept)
SELECT lang, rank::BIGINT AS rank, phrase, a, l, r, n, score FROM o JOIN n USING (lang) WHERE rank <= 2000
"""
