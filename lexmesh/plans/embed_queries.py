"""Scripts, embedding statistics, initialisation and projection over `embeddings`."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lexmesh.functions.text import chunk_pieces
from lexmesh.operators import embed, projection, scripts, similarity
from lexmesh.operators.vocabulary import attach_ids, characters
from lexmesh.plans import sqltext as q
from lexmesh.plans.bindings import dims, embeddings, lines, long_form, new_vocab, old_matrix, old_vocab, tokens
from lexmesh.plans.registry import Tables, query
from lexmesh.session import lookup, scratch_folder
from lexmesh.sources.scripts import UNLISTED, expand_ranges, read_script_table, unicode_script_ranges
from lexmesh.sources.vectors import load_vocab_embeddings as join_vectors

_BASE = (q.LINES, q.TOKENS, q.VOCABS)
_SPECIAL = str(scripts.SPECIAL_TOKENS)


@query("load_vocab_embeddings", q.with_(*_BASE, "SELECT id, token, dim, round(value, 6) + 0.0 AS value FROM old_vocab JOIN vectors USING (id)"))
def load_vocab_embeddings(t: Tables):
    return long_form(join_vectors(old_vocab(t), embeddings(t)).select("id", "token", "vector"))


@query("load_script_table", q.with_(q.LINES, f"""
SELECT unicode(ch)::BIGINT AS cp, {q.script('ch')} AS script, count(*) AS n
FROM (SELECT unnest(string_split(line, '')) AS ch FROM lines) GROUP BY ch"""))
def load_script_table(t: Tables):
    counted = lines(t).select(F.explode(characters(F.col("line"))).alias("ch")).groupBy("ch").agg(F.count(F.lit(1)).alias("n"))
    path = scratch_folder(t.spark, "scripts")
    bound = lambda c: F.lpad(F.hex(c), 4, "0")
    span = F.when(F.col("cp_from") == F.col("cp_to"), bound("cp_from")).otherwise(F.concat(bound("cp_from"), F.lit(".."), bound("cp_to")))
    unicode_script_ranges(t.spark).select(F.concat(span, F.lit(" ; "), "script", F.lit(" # listed"))).write.text(path)
    table = expand_ranges(read_script_table(t.spark, path))
    points = counted.select(F.ascii("ch").alias("cp"), "n")
    return lookup(points, table, ["cp"], "left").select("cp", F.coalesce("script", F.lit(UNLISTED)).alias("script"), "n")


@query("char_scripts", q.with_(*_BASE, f"""
SELECT token, id, unnest(range(1, length(token) + 1)) AS pos, unnest(string_split(token, '')) AS ch, {q.script("unnest(string_split(token, ''))")} AS script
FROM new_vocab"""))
def char_scripts(t: Tables):
    return scripts.char_scripts(new_vocab(t))


_OLD = q.categories("old_vocab", "old_cat", False)
_OLD_POS = q.categories("old_vocab", "old_cat", True)
_NEW = q.categories("new_vocab", "new_cat", False)
_NEW_POS = q.categories("new_vocab", "new_cat", True)


@query("top_script", q.with_(*_BASE, _NEW, "SELECT token, id, category AS script FROM new_cat WHERE category <> 'xlmr_special'"))
def top_script(t: Tables):
    return scripts.with_scripts(new_vocab(t)).select("token", "id", scripts.top_script(F.col("scripts")).alias("script"))


@query("top_script_preferred", q.with_(*_BASE, _NEW, """
SELECT token, id, script FROM (
  SELECT *, row_number() OVER (PARTITION BY id ORDER BY n DESC, (script IN ('Common')) DESC, seen) AS r FROM new_cat_counts) WHERE r = 1"""))
def top_script_preferred(t: Tables):
    found = scripts.with_scripts(new_vocab(t))
    return found.select("token", "id", scripts.top_script(F.col("scripts"), ["Common"]).alias("script"))


@query("script_categories", q.with_(*_BASE, _NEW_POS, "SELECT token, id, category FROM new_cat"))
def script_categories(t: Tables):
    return scripts.script_categories(new_vocab(t), word_position=True)


@query("script_token_counts", q.with_(*_BASE, _OLD, "SELECT category, count(*) AS tokens FROM old_cat GROUP BY category"))
def script_token_counts(t: Tables):
    return scripts.script_token_counts(scripts.script_categories(old_vocab(t)))


@query("script_cluster_select", q.with_(*_BASE, _OLD, "counts AS (SELECT category AS script, count(*) AS tokens FROM old_cat GROUP BY category)", """
SELECT script, tokens, 'cluster' AS view FROM counts WHERE script NOT IN ('Cyrillic', 'Braille', 'Common', 'Latin') UNION ALL
SELECT script, tokens, 'frequent' FROM counts WHERE tokens > 100 OR script IN ('Katakana', 'Hiragana') UNION ALL
SELECT script, tokens, 'Semitic' FROM counts WHERE script IN ('Arabic', 'Hebrew', 'Syriac') UNION ALL
SELECT script, tokens, 'Japanese' FROM counts WHERE script IN ('Hiragana', 'Katakana') UNION ALL
SELECT script, tokens, 'Chinese' FROM counts WHERE script IN ('Bopomofo', 'Han')"""))
def script_cluster_select(t: Tables):
    counts = scripts.script_token_counts(scripts.script_categories(old_vocab(t)))
    return scripts.script_cluster_select(counts, frequent_above=100)


@query("category_moments", """
SELECT label AS category, dim, count(*) AS n, round(avg(value), 6) + 0.0 AS mean, round(stddev_samp(value), 6) + 0.0 AS std
FROM (SELECT label, unnest(range(0, len(embedding))) AS dim, unnest(embedding)::DOUBLE AS value FROM embeddings) GROUP BY label, dim""")
def category_moments(t: Tables):
    found = embed.moments_by_dim(embed.category_moments(embeddings(t).withColumnRenamed("label", "category")))
    return found.withColumn("mean", F.round("mean", 6)).withColumn("std", F.round("std", 6))


@query("overall_moments", """
SELECT dim, count(*) AS n, round(avg(value), 6) + 0.0 AS mean, round(stddev_samp(value), 6) + 0.0 AS std
FROM (SELECT unnest(range(0, len(embedding))) AS dim, unnest(embedding)::DOUBLE AS value FROM embeddings) GROUP BY dim""")
def overall_moments(t: Tables):
    return embed.moments_by_dim(embed.overall_moments(embeddings(t))).withColumn("mean", F.round("mean", 6)).withColumn("std", F.round("std", 6))


_DIMS = "dims AS (SELECT DISTINCT dim FROM vectors)"
_START = q.normal(1, "'start'", "id", "dim")
_DRAW = q.normal(1, "'category'", "id", "dim")


@query("init_random", q.with_(*_BASE, _DIMS, f"SELECT token, id, dim, round({_START}, 6) + 0.0 AS value FROM new_vocab, dims"))
def init_random(t: Tables):
    return long_form(embed.init_random(new_vocab(t), dims(t)))


_OLD_ROWS = "old_rows AS (SELECT token, dim, value FROM old_vocab JOIN vectors USING (id))"


@query("copy_special", q.with_(*_BASE, _OLD_ROWS, f"""
SELECT token, n.id, dim, round(value, 6) + 0.0 AS value FROM new_vocab n JOIN old_rows USING (token) WHERE token IN {_SPECIAL}"""))
def copy_special(t: Tables):
    return long_form(embed.copy_special(old_matrix(t), new_vocab(t)))


@query("init_by_identity", q.with_(*_BASE, _OLD_ROWS, f"""
SELECT token, n.id, dim, round(value, 6) + 0.0 AS value FROM new_vocab n JOIN old_rows USING (token) WHERE token NOT IN {_SPECIAL}"""))
def init_by_identity(t: Tables):
    return long_form(embed.init_by_identity(old_matrix(t), new_vocab(t)))


_MOMENTS = """moments AS (
  SELECT category, dim, avg(value) AS mean, coalesce(stddev_samp(value), 0.0) AS std
  FROM old_cat JOIN vectors USING (id) WHERE category <> 'xlmr_special' GROUP BY category, dim)"""


@query("init_by_category", q.with_(*_BASE, _OLD_POS, _NEW_POS, _MOMENTS, f"""
SELECT token, id, category, dim, round(mean + std * {_DRAW}, 6) + 0.0 AS value FROM new_cat JOIN moments USING (category)"""))
def init_by_category(t: Tables):
    old, new = old_matrix(t), new_vocab(t)
    return long_form(embed.init_by_category(old, scripts.script_categories(old, True), scripts.script_categories(new, True)))


@query("init_combined", q.with_(*_BASE, _OLD_POS, _NEW_POS, _MOMENTS, _OLD_ROWS, _DIMS, f"""
SELECT token, id, dim, CASE WHEN token IN {_SPECIAL} AND same IS NOT NULL THEN 'special' WHEN same IS NOT NULL THEN 'identity'
    WHEN drawn IS NOT NULL THEN 'script' ELSE 'random' END AS origin,
  round(coalesce(same, CASE WHEN token NOT IN {_SPECIAL} THEN drawn END, start), 6) + 0.0 AS value
FROM (SELECT n.token, n.id, dim, o.value AS same, m.mean + m.std * {_DRAW.replace('id, dim', 'n.id, dim')} AS drawn, {_START.replace('id, dim', 'n.id, dim')} AS start
  FROM new_vocab n CROSS JOIN dims LEFT JOIN old_rows o USING (token, dim)
  LEFT JOIN (SELECT * FROM new_cat WHERE category <> 'xlmr_special') c ON c.id = n.id LEFT JOIN moments m USING (category, dim))"""))
def init_combined(t: Tables):
    found = embed.init_combined(old_matrix(t), new_vocab(t), dims(t), **embed.PRESETS["script+pos+ident"])
    return long_form(found)


def _moments(categories: str, name: str) -> str:
    return _MOMENTS.replace("moments AS", f"{name} AS").replace("old_cat", categories)


_FLAGS = ", ".join(f"('{name}', {', '.join(str(flag in flags).lower() for flag in ('by_script', 'by_position', 'by_identity'))})" for name, flags in embed.PRESETS.items())
_PRESETS = f"presets(preset, by_script, by_position, by_identity) AS (VALUES {_FLAGS})"


@query("init_presets", q.with_(
    *_BASE, *[q.categories(f"{v}_vocab", f"{v}_{k}", k == "pos") for v in ("old", "new") for k in ("plain", "pos")],
    _moments("old_plain", "moments_plain"), _moments("old_pos", "moments_pos"), _OLD_ROWS, _DIMS, _PRESETS, f"""
starts AS (SELECT token, id, dim, {_START} AS start, {_DRAW} AS z FROM new_vocab CROSS JOIN dims),
plain_draws AS (SELECT c.id, m.dim, mean, std FROM new_plain c JOIN moments_plain m USING (category) WHERE category <> 'xlmr_special'),
pos_draws AS (SELECT c.id, m.dim, mean, std FROM new_pos c JOIN moments_pos m USING (category) WHERE category <> 'xlmr_special'),
cells AS (SELECT s.*, o.value AS same, a.mean + a.std * z AS plain_draw, b.mean + b.std * z AS pos_draw, s.token IN {_SPECIAL} AS special
  FROM starts s LEFT JOIN old_rows o USING (token, dim) LEFT JOIN plain_draws a ON a.id = s.id AND a.dim = s.dim LEFT JOIN pos_draws b ON b.id = s.id AND b.dim = s.dim),
drawn AS (SELECT *, CASE WHEN by_script AND NOT special THEN CASE WHEN by_position THEN pos_draw ELSE plain_draw END END AS draw FROM cells CROSS JOIN presets),
chosen AS (SELECT preset, CASE WHEN special AND same IS NOT NULL THEN 'special' WHEN by_identity AND NOT special AND same IS NOT NULL THEN 'identity'
    WHEN draw IS NOT NULL THEN 'script' ELSE 'random' END AS origin, same, draw, start FROM drawn)""", """
SELECT preset, origin, count(*) AS entries,
       round(sum(CASE origin WHEN 'special' THEN same WHEN 'identity' THEN same WHEN 'script' THEN draw ELSE start END), 4) + 0.0 AS total
FROM chosen GROUP BY preset, origin"""))
def init_presets(t: Tables):
    old, new, width = old_matrix(t), new_vocab(t), dims(t)
    matrices = [embed.init_combined(old, new, width, **flags).withColumn("preset", F.lit(name)) for name, flags in embed.PRESETS.items()]
    total = F.aggregate("vector", F.lit(0.0), lambda a, x: a + x)
    rows = reduce(DataFrame.unionByName, matrices).select("preset", "origin", F.size("vector").alias("entries"), total.alias("total"))
    return rows.groupBy("preset", "origin").agg(F.sum("entries").alias("entries"), F.round(F.sum("total"), 4).alias("total"))


@query("init_by_similarity", q.with_(*_BASE, f"""
aux AS (SELECT vec_id AS id, embedding::DOUBLE[] AS v FROM embeddings),
overlap AS (SELECT n.id, o.id AS old_id, a.v FROM new_vocab n JOIN old_vocab o USING (token) JOIN aux a ON a.id = n.id),
missing AS (SELECT n.id, a.v FROM new_vocab n JOIN aux a USING (id) WHERE token NOT IN (SELECT token FROM old_vocab)),
similar_ AS (SELECT m.id, o.old_id, list_cosine_similarity(m.v, o.v) AS z FROM missing m CROSS JOIN overlap o),
ordered AS (SELECT id, z, row_number() OVER w AS k, sum(z) OVER (w ROWS UNBOUNDED PRECEDING) AS s FROM similar_ WINDOW w AS (PARTITION BY id ORDER BY z DESC)),
cuts AS (SELECT id, arg_max((s - 1.0) / k, k) AS cut FROM ordered WHERE 1 + k * z > s GROUP BY id),
weighted AS (SELECT id, old_id, z - cut AS w FROM similar_ JOIN cuts USING (id) WHERE z > cut)""", """
SELECT w.id, dim, round(sum(w * value), 5) + 0.0 AS value FROM weighted w JOIN vectors v ON v.id = w.old_id GROUP BY w.id, dim"""))
def init_by_similarity(t: Tables):
    new, old = new_vocab(t), old_matrix(t)
    aux = embeddings(t).select("id", F.col("vector").alias("aux"))
    described = new.join(aux, "id")
    overlap = described.join(old.select("token", "vector"), "token").select("id", "aux", "vector")
    missing = described.join(old.select("token"), "token", "left_anti").select("id", "aux")
    return long_form(similarity.init_by_similarity(missing, overlap), 5)


@query("fit_pca")
def fit_pca(t: Tables):
    vectors = embeddings(t).select("id", "vector")
    scored = projection.project_pca(vectors, projection.fit_pca(vectors))
    return scored.select("id", F.round("pc1", 6).alias("pc1"), F.round("pc2", 6).alias("pc2"))


@query("project_pca")
def project_pca(t: Tables):
    vectors = embeddings(t)
    fitted = projection.fit_pca(vectors.select("id", "vector"))
    means = embed.moment_vectors(embed.category_moments(vectors.withColumnRenamed("label", "category")))
    scored = projection.project_pca(means.select("category", F.col("mean").alias("vector")), fitted)
    return scored.select("category", F.round("pc1", 6).alias("pc1"), F.round("pc2", 6).alias("pc2"))


def _points(t: Tables):
    x, y = [F.get("vector", F.lit(i)).cast("double") for i in (0, 1)]
    return embeddings(t).select("id", "label", x.alias("x"), y.alias("y"))


@query("confidence_ellipse", """
SELECT script, n, round(mean_x, 6) + 0.0 AS mean_x, round(mean_y, 6) + 0.0 AS mean_y, round(r, 6) + 0.0 AS pearson, round(sqrt(1 + r), 6) + 0.0 AS radius_x,
       round(sqrt(1 - r), 6) + 0.0 AS radius_y, round(sqrt(vx) * 3, 6) + 0.0 AS scale_x, round(sqrt(vy) * 3, 6) + 0.0 AS scale_y
FROM (SELECT label AS script, count(*) AS n, avg(x) AS mean_x, avg(y) AS mean_y, var_samp(x) AS vx, var_samp(y) AS vy,
        covar_samp(x, y) / sqrt(var_samp(x) * var_samp(y)) AS r
  FROM (SELECT label, embedding[1]::DOUBLE AS x, embedding[2]::DOUBLE AS y FROM embeddings) GROUP BY label HAVING count(*) > 2)""")
def confidence_ellipse(t: Tables):
    found = projection.confidence_ellipse(_points(t).withColumnRenamed("label", "script"))
    return found.select("script", "n", *[F.round(c, 6).alias(c) for c in found.columns if c not in ("script", "n")])


@query("word_position_points", q.with_(*_BASE, _OLD, """
points AS (SELECT c.token, c.category, e.embedding[1]::DOUBLE AS x, e.embedding[2]::DOUBLE AS y,
    CASE WHEN c.token LIKE '▁%' THEN 'Initial' ELSE 'Medial' END AS word_position
  FROM old_cat c JOIN embeddings e ON e.vec_id = c.id WHERE c.category <> 'xlmr_special')""", """
SELECT token, view, word_position, round(x, 6) + 0.0 AS x, round(y, 6) + 0.0 AS y FROM (
  SELECT *, 'All scripts' AS view FROM points UNION ALL
  SELECT *, 'Common/Cyrillic/Latin' FROM points WHERE category IN ('Common', 'Cyrillic', 'Latin') UNION ALL
  SELECT *, category FROM points)"""))
def word_position_points(t: Tables):
    scripted = scripts.script_categories(old_vocab(t)).filter(F.col("category") != scripts.SPECIAL_CATEGORY)
    points = scripted.join(_points(t).drop("label"), "id")
    return projection.word_position_points(points).select("token", "view", "word_position", F.round("x", 6).alias("x"), F.round("y", 6).alias("y"))


@query("pool_word_vectors", q.with_(*_BASE, """
words AS (SELECT DISTINCT word FROM tokens),
alignment AS (SELECT word, unnest(""" + q.pieces("word", 3) + """) AS token FROM words)""", """
SELECT word, count(*) AS dims, round(sum(value), 4) + 0.0 AS total, round(sum(value * value), 4) + 0.0 AS squares FROM (
  SELECT word, dim, avg(value) AS value FROM (SELECT word, coalesce(id, 3) AS id FROM alignment LEFT JOIN old_vocab USING (token)) JOIN vectors USING (id) GROUP BY word, dim) GROUP BY word"""))
def pool_word_vectors(t: Tables):
    distinct = tokens(t).select("word").distinct()
    pieces = distinct.select("word", F.explode(chunk_pieces(F.col("word"), 3)).alias("token"))
    alignment = attach_ids(pieces, old_vocab(t)).select("word", "id")
    pooled = embed.pool_word_vectors(alignment, embeddings(t).select("id", "vector"))
    total = F.aggregate("vector", F.lit(0.0), lambda a, x: a + x)
    squares = F.aggregate("vector", F.lit(0.0), lambda a, x: a + x * x)
    return pooled.select("word", F.size("vector").alias("dims"), F.round(total, 4).alias("total"), F.round(squares, 4).alias("squares"))
