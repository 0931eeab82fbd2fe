"""Chunkers: a text to its pieces, as array expressions; and what belongs to a piece."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Limits in code points, and suffixes that count as code.
CODE_LIMIT, PROSE_LIMIT, OVERLAP = 350, 800, 120
CODE = (".py", ".js", ".ts", ".jsx", ".tsx", ".java", ".c", ".cpp", ".h", ".hpp", ".cs", ".go", ".rs", ".rb", ".php", ".swift", ".kt", ".scala", ".sh", ".sql", ".r", ".m")

LIVE_CODE = (".py", ".go", ".rs", ".ts", ".js", ".sh", ".bash", ".c", ".cpp", ".java")

#: Pieces that a fold appends to one array; full arrays are set aside, so that a long text takes no quadratic time.
FOLD_BLOCK = 256


def _folded(items: Column, state: dict[str, Column], step, end) -> Column:
    """Pieces put out along items: step(state, item) gives the next state, whether a piece ends before the item, and that piece; end(state) gives the last pieces."""
    zero = F.struct(*[v.alias(k) for k, v in state.items()], F.array().cast("array<string>").alias("out"), F.array().cast("array<array<string>>").alias("outs"))

    def run(acc: Column, x: Column) -> Column:
        after, ends, piece = step(acc, x)
        full = F.size(acc["out"]) >= FOLD_BLOCK
        out = F.when(full, F.array().cast("array<string>")).otherwise(acc["out"])
        outs = F.when(full, F.array_append(acc["outs"], acc["out"])).otherwise(acc["outs"])
        return F.struct(*[after[k].alias(k) for k in state], F.when(ends, F.array_append(out, piece)).otherwise(out).alias("out"), outs.alias("outs"))

    return F.aggregate(items, zero, run, lambda acc: F.flatten(F.concat(acc["outs"], F.array(acc["out"]), F.array(end(acc)))))


def _packed(parts: Column, limit: int, cost: int, join: str) -> Column:
    """Parts packed greedily: a part that would pass the limit begins a new piece; a part longer than it stays whole."""

    def step(acc: Column, part: Column):
        size = F.length(part) + cost
        full = (acc["size"] + size > limit) & (F.size(acc["now"]) > 0)
        now = F.when(full, F.array(part)).otherwise(F.array_append(acc["now"], part))
        return {"now": now, "size": F.when(full, 0).otherwise(acc["size"]) + size}, full, F.array_join(acc["now"], join)

    end = lambda acc: F.when(F.size(acc["now"]) > 0, F.array(F.array_join(acc["now"], join))).otherwise(F.array().cast("array<string>"))
    return _folded(parts, {"now": F.array().cast("array<string>"), "size": F.lit(0)}, step, end)


def _strip(text: Column) -> Column:
    return F.regexp_replace(text, r"(?U)^\s+|\s+$", "")


def code_pieces(text: Column, limit: int = CODE_LIMIT) -> Column:
    """Lines packed to the limit; joined by line feeds the pieces are the text again. An empty text has none."""
    return F.when(text != "", _packed(F.split(text, "\n", -1), limit, 1, "\n")).otherwise(F.array().cast("array<string>"))


def live_pieces(text: Column, path_suffix: Column) -> Column:
    """Pieces of the live indexer, each part with its own end: lines to 350 for code, else paragraphs (parted by two line feeds) to 800."""
    ended = lambda by: F.transform(F.split(text, by, -1), lambda x: F.concat(x, F.lit(by)))
    pieces = F.when(path_suffix.isin(*LIVE_CODE), _packed(ended("\n"), CODE_LIMIT, 0, "")).otherwise(_packed(ended("\n\n"), PROSE_LIMIT, 0, ""))
    return F.when(text != "", pieces).otherwise(F.array().cast("array<string>"))


def paragraph_pieces(text: Column, limit: int = PROSE_LIMIT) -> Column:
    """Paragraphs (parted by blank lines, stripped) packed to the limit and joined by a blank line; a longer one is packed by its sentences.

    Sentences and what ends them are parts of their own; a piece of sentences is stripped, and none holds text of two paragraphs.
    """
    paragraphs = F.filter(F.transform(F.split(text, r"(?U)\n\s*\n", -1), _strip), lambda p: p != "")
    part = lambda x, kind: F.struct(x.alias("x"), kind.alias("kind"))
    ends = lambda p: F.concat(F.regexp_extract_all(p, F.lit(r"(?U)[.!?]+\s+"), F.lit(0)), F.array(F.lit(None).cast("string")))
    sentences = lambda p: F.filter(F.flatten(F.zip_with(F.split(p, r"(?U)[.!?]+\s+", -1), ends(p), lambda a, b: F.array(a, b))), lambda x: x.isNotNull())
    short, first, later = F.lit(0), F.lit(1), F.lit(2)
    parts = F.flatten(F.transform(paragraphs, lambda p: F.when(F.length(p) > limit, F.transform(sentences(p), lambda x, i: part(x, F.when(i == 0, first).otherwise(later)))).otherwise(F.array(part(p, short)))))

    def piece(acc: Column) -> Column:
        return F.when(acc["prose"], F.array_join(acc["now"], "\n\n")).otherwise(_strip(F.array_join(acc["now"], "")))

    def step(acc: Column, x: Column):
        held, size = F.size(acc["now"]) > 0, F.length(x["x"])
        over = acc["size"] + size > limit
        cut = held & ((x["kind"] == first) | ((x["kind"] == short) & (~acc["prose"] | over)) | ((x["kind"] == later) & over))
        # a paragraph that begins a piece by passing the limit counts without the blank line after it
        own = size + F.when((x["kind"] == short) & ~(acc["prose"] & held & over), 2).otherwise(0)
        now = F.when(cut, F.array(x["x"])).otherwise(F.array_append(acc["now"], x["x"]))
        return {"now": now, "size": F.when(cut, 0).otherwise(acc["size"]) + own, "prose": x["kind"] == short}, cut, piece(acc)

    state = {"now": F.array().cast("array<string>"), "size": F.lit(0), "prose": F.lit(True)}
    return _folded(parts, state, step, lambda acc: F.when(F.size(acc["now"]) > 0, F.array(piece(acc))).otherwise(F.array().cast("array<string>")))


def overlapping_pieces(text: Column, limit: int = PROSE_LIMIT, overlap: int = OVERLAP, snap: int = 100) -> Column:
    """Windows of the limit, stripped; an end within `snap` of a blank line moves to the first such, and the next window begins `overlap` before the end."""
    n = F.length(text)

    def step(acc: Column, _: Column):
        start, wanted = acc["start"], acc["start"] + limit
        found = F.locate("\n\n", F.substring(text, wanted - snap + 1, F.lit(2 * snap)))
        end = F.when((wanted < n) & (found > 0), wanted - snap + found - 1).otherwise(wanted)
        piece = _strip(F.substring(text, start + 1, end - start))
        return {"start": F.when(start < n, end - overlap).otherwise(start)}, (start < n) & (piece != ""), piece

    turns = F.sequence(F.lit(0), F.floor(n / F.lit(limit - snap - overlap)).cast("int") + 1)
    return F.when(n > 0, _folded(turns, {"start": F.lit(0)}, step, lambda acc: F.array().cast("array<string>"))).otherwise(F.array().cast("array<string>"))


def exploded(files: DataFrame, pieces: Column) -> DataFrame:
    """file_path, chunk_index, content."""
    return files.select("file_path", F.posexplode(pieces).alias("chunk_index", "content"))


def chunk_code(files: DataFrame) -> DataFrame:
    return exploded(files, code_pieces(F.col("content")))


def strategy(path_suffix: Column) -> Column:
    return F.when(path_suffix.isin(*CODE), "code_discrete").otherwise("prose_discrete")


def envelope(chunks: DataFrame) -> DataFrame:
    """Chunks with their total, size, place in the file and neighbours two to either side."""
    from pyspark.sql.window import Window

    total = F.count("*").over(Window.partitionBy("file_path"))
    i, n = F.col("chunk_index"), F.col("total_chunks")
    return chunks.withColumn("total_chunks", total).select(
        "file_path",
        "chunk_index",
        "total_chunks",
        F.length("content").alias("chunk_size"),
        F.when(i == 0, "start").when(i == n - 1, "end").otherwise("middle").alias("position"),
        (i > 0).alias("has_previous"),
        (i < n - 1).alias("has_next"),
        F.array_join(F.sequence(F.greatest(i - 2, F.lit(0)), F.least(i + 2, (n - 1).cast("int"))), ",").alias("adjacent"),
        F.left("content", F.lit(50)).alias("starts_with"),
        F.right("content", F.lit(50)).alias("ends_with"),
        F.when(n > 3, "adjacent_1").otherwise("full_file").alias("suggestion"),
    )


def adjacent(hits: DataFrame, chunks: DataFrame, before: int = 1, after: int = 1, with_self: bool = True) -> DataFrame:
    """Neighbours of hits (file_path, chunk_index): one join on exploded indices instead of a lookup a hit."""
    offsets = F.filter(F.sequence(F.lit(-before), F.lit(after)), lambda o: F.lit(with_self) | (o != 0))
    wanted = hits.select("file_path", F.col("chunk_index").alias("hit_index"), F.explode(offsets).alias("offset")).withColumn("chunk_index", F.col("hit_index") + F.col("offset"))
    return wanted.join(chunks, ["file_path", "chunk_index"]).select("file_path", "hit_index", "chunk_index", "content")


def as_json(envelope: DataFrame) -> DataFrame:
    """file_path, chunk_index and the envelope as one JSON text."""
    return envelope.select("file_path", "chunk_index", F.to_json(F.struct(*envelope.columns)).alias("envelope"))


def from_json(rows: DataFrame, schema: str) -> DataFrame:
    return rows.select(F.from_json("envelope", schema).alias("e")).select("e.*")


def stats(chunks: DataFrame) -> DataFrame:
    size = F.length("content")
    return chunks.groupBy("file_path").agg(F.count("*").alias("n"), F.sum(size).alias("total_size"), F.round(F.avg(size), 2).alias("avg_size"), F.min(size).alias("min_size"), F.max(size).alias("max_size"))
