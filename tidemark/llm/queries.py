"""The queries of this subpackage and what SQL can express of them."""

from __future__ import annotations

from . import alignment, bpe, counts, embeddings, merkle, mixing, packing, quality, secrets, simhash, substring, toxicity, warc

QUERIES = {
    "op1_bpe": bpe.op1_bpe,
    "op2_pack": packing.op2_pack,
    "op3_token_counts": counts.op3_token_counts,
    "op8_warc": warc.op8_warc,
    "op5_toxicity": toxicity.op5_toxicity,
    "op4_simhash": simhash.op4_simhash,
    "op7_secrets": secrets.op7_secrets,
    "op9_substring": substring.op9_substring,
    "op10_quality": quality.op10_quality,
    "op6_embeddings": embeddings.op6_embeddings,
    "op11_merkle": merkle.op11_merkle,
    "op12_alignment": alignment.op12_alignment,
    "op13_mixing": mixing.op13_mixing,
}

ALPHABET = "ABCDEFGHIJKLMNOPQRSTUVWXYZ234567"
#: 40 hexadecimal digits in base 32: five of them are four signs.
BASE32 = " || ".join(
    f"substr('{ALPHABET}', ((('0x' || substr(sha, {5 * (j // 4) + 1}, 5))::BIGINT >> {15 - 5 * (j % 4)}) & 31)::INT + 1, 1)" for j in range(32)
)



def merkle_sql(sub: int = 5, top: int = 2) -> str:
    """op11 with so many levels of groups and of sources at most: 16 ** sub leaves, 16 ** top sources."""
    enc = lambda c: f"coalesce(octet_length(encode({c}::VARCHAR))::VARCHAR || ':' || {c}::VARCHAR, '-')"
    head = " || ".join(enc(c) for c in ("doc_id", "source", "lang", "n_chars"))
    capital = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
    # the remainder of a cyclic redundancy check, bit by bit: a byte is put in, eight shifts follow
    crc = (
        "xor(list_reduce(list_prepend(4294967295, flatten(list_transform(string_split(doc_id::VARCHAR, ''), lambda c: [ascii(c)::BIGINT, -1, -1, -1, -1, -1, -1, -1, -1]))), "
        "lambda a, x: CASE WHEN x >= 0 THEN xor(a, x) ELSE xor(a >> 1, 3988292384 * (a & 1)) END), 4294967295)"
    )
    tables = [
        f"leaves AS (SELECT doc_id, source, sha256({head} || {enc('text')}) AS leaf, "
        f"CASE WHEN {crc} % 5 = 0 THEN sha256({head} || {enc(f"translate(text, '{capital}', '{capital.lower()}')")}) END AS tampered FROM documents)",
        "low0 AS (SELECT source AS g, row_number() OVER (PARTITION BY source ORDER BY doc_id NULLS FIRST, leaf) - 1 AS pos, count(*) OVER (PARTITION BY source) AS size, leaf AS h FROM leaves)",
    ]

    def levels(name: str, n: int) -> None:
        for k in range(n):
            tables.append(f"{name}runs{k} AS (SELECT g, pos // 16 AS run, string_agg(h, '' ORDER BY pos) AS nodes, any_value(size) AS size FROM {name}{k} GROUP BY g, pos // 16)")
            tables.append(f"{name}{k + 1} AS (SELECT g, run AS pos, (size + 15) // 16 AS size, CASE WHEN size = 1 THEN nodes ELSE sha256(nodes) END AS h FROM {name}runs{k})")

    levels("low", sub)
    tables.append(f"high0 AS (SELECT 0 AS g, row_number() OVER (ORDER BY g NULLS FIRST) - 1 AS pos, count(*) OVER () AS size, h, g AS source FROM low{sub})")
    levels("high", top)
    row = "SELECT l.doc_id, l.leaf, s.h AS subroot, r.h AS root, coalesce(l.tampered, l.leaf) AS f0, '' AS p0"
    steps = [("low", k, f"(l.pos // {16**k})", "l.source") for k in range(sub)] + [("high", k, f"(s.pos // {16**k})", "0") for k in range(top)]
    joins = ""
    for i, (name, k, at, g) in enumerate(steps):
        row += f", x{i}.nodes AS n{i}, x{i}.size AS z{i}, {at} % 16 AS a{i}"
        joins += f" JOIN {name}runs{k} x{i} ON x{i}.g IS NOT DISTINCT FROM {g} AND x{i}.run = {at} // 16"
    placed = "(SELECT *, row_number() OVER (PARTITION BY source ORDER BY doc_id NULLS FIRST, leaf) - 1 AS pos FROM leaves) l"
    tables.append(f"step0 AS ({row} FROM {placed} JOIN high0 s ON s.source IS NOT DISTINCT FROM l.source JOIN high{top} r ON true{joins})")
    for i in range(len(steps)):
        beside = f"substr(n{i}, 1, 64 * a{i}), substr(n{i}, 64 * a{i} + 65)"
        tables.append(
            f"step{i + 1} AS (SELECT *, CASE WHEN z{i} = 1 THEN f{i} ELSE sha256(substr(n{i}, 1, 64 * a{i}) || f{i} || substr(n{i}, 64 * a{i} + 65)) END AS f{i + 1}, "
            f"CASE WHEN z{i} = 1 THEN p{i} ELSE concat(p{i}, {beside}) END AS p{i + 1} FROM step{i})"
        )
    n = len(steps)
    return f"WITH {', '.join(tables)} SELECT doc_id, leaf, subroot, root, sha256(p{n}) AS proof_sha256, f{n} AS folded_root, f{n} = root AS verified FROM step{n}"


SQL: dict[str, str] = {
    "op11_merkle": merkle_sql(),
    "op13_mixing": mixing.SQL,
    "op8_warc": f"""
WITH p AS (SELECT page_id, coalesce(html, '') AS html FROM pages),
s AS (SELECT page_id, octet_length(encode(html)) AS size, sha1(html) AS sha FROM p),
m AS (SELECT page_id, size, {BASE32} AS digest, max(page_id) OVER (PARTITION BY sha) AS last FROM s)
SELECT page_id, size::BIGINT AS payload_bytes, digest AS payload_digest,
  CASE WHEN page_id = last THEN 'response' ELSE 'revisit' END AS record_type,
  CASE WHEN page_id = last THEN NULL ELSE last END AS refers_to
FROM m""",
    "op6_embeddings": """
WITH RECURSIVE v AS (SELECT vec_id, embedding::DOUBLE[] AS e FROM embeddings),
sound AS (SELECT vec_id, e FROM v WHERE CASE WHEN len(e) > 0 AND list_count(e) = len(e) THEN isfinite(list_dot_product(e, e)) AND list_dot_product(e, e) > 0 ELSE false END),
link AS (SELECT a.vec_id AS a, b.vec_id AS b FROM sound a, sound b
  WHERE a.vec_id <> b.vec_id AND CASE WHEN len(a.e) = len(b.e) THEN list_cosine_similarity(a.e, b.e) >= 0.9 ELSE false END),
reach AS (SELECT vec_id AS a, vec_id AS b FROM v UNION SELECT r.a, l.b FROM reach r JOIN link l ON r.b = l.a),
least AS (SELECT a, min(b) AS component_id FROM reach GROUP BY a),
n AS (SELECT a, count(*) AS n_links FROM link GROUP BY a)
SELECT l.a AS vec_id, coalesce(n.n_links, 0)::BIGINT AS n_links, l.component_id, l.a = l.component_id AS kept
FROM least l LEFT JOIN n ON n.a = l.a""",
}
