"""Exact lexical top-k for batches of queries: packed parts of the documents meet packed blocks of queries, each pair once."""

from __future__ import annotations

from collections.abc import Iterable, Iterator
from dataclasses import dataclass
from types import SimpleNamespace

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ledgerloom.session import checkpointed

# Fixed values. Parameters of the ranking function.
K1, B, EPSILON = 1.5, 0.75, 0.25
#: What a task holds at once: documents (their places fit 16 bits), words and queries.
PART, PART_WORDS, SLICE, BLOCK = 65_536, 4_000_000, 8_192, 4_096
#: A term in more than one of so many documents is common.
COMMON = 32


@dataclass
class Index:
    """Parts of the documents with their postings, written once, and the statistics of all documents."""

    parts: DataFrame
    idf: DataFrame
    n: int
    avgdl: float
    key: str
    kind: str
    within: str | None


def indexed(docs: DataFrame, key: str, words: str, within: str | None = None) -> Index:
    """The index of ``docs``, one row for each key, by the words of an array. A search can be kept to a value of ``within``."""
    kind = docs.schema[key].dataType.simpleString()
    rows = docs.select(F.col(key).alias("key"), (F.col(within).cast("string") if within else F.lit(None).cast("string")).alias("scope"), F.col(words).alias("words"))
    schema = f"n bigint, total bigint, keys array<{kind}>, scopes array<string>, vocab array<string>, df array<int>, ptr binary, docs binary, tf binary, dl binary"
    parts = checkpointed(rows.mapInArrow(_packed, schema))
    one = parts.agg(F.sum("n").alias("n"), F.sum("total").alias("total")).first()
    n, total = one.n or 0, one.total or 0
    df = parts.select(F.explode(F.arrays_zip("vocab", "df")).alias("t")).groupBy(F.col("t.vocab").alias("term")).agg(F.sum("t.df").alias("df"))
    raw = df.withColumn("raw", F.log(F.lit(float(n)) - F.col("df") + 0.5) - F.log(F.col("df") + 0.5))
    idf = raw.crossJoin(F.broadcast(raw.agg(F.avg("raw").alias("mean")))).select("term", "df", F.when(F.col("raw") < 0, EPSILON * F.col("mean")).otherwise(F.col("raw")).alias("idf"))
    return Index(parts, idf, n, total / n if n else 0.0, key, kind, within)


def search(index: Index, queries: DataFrame, query_key: str, words: str, k: int, within: str | None = None, flat: bool = False, shared: bool = False, carry: list[str] | None = None) -> DataFrame:
    """(query_key, key, score, rank): the k best documents of each query by BM25, exactly, ties by key.

    ``flat`` counts shared words instead: a term adds 1 wherever it stands. ``shared`` adds a column with the number of
    distinct words that both have; columns of the queries in ``carry`` come along. ``within`` names a column of the queries that must equal that of the index.

    A query's common terms are few and most queries have them in common, so their sums are taken once for all queries with the same ones.
    Without its other terms a document can only be among the k best by that sum; all others are in the postings of the
    rare terms. Equal bags of words are searched once.
    """
    scope, carry = [within] if within else [], carry or []
    bags = queries.select(query_key, *scope, *carry, F.array_sort(words).alias("bag")).where(" and ".join(f"{c} is not null" for c in ("bag", *scope)))
    asked = checkpointed(bags.select("bag", *scope).distinct().withColumn("q", F.monotonically_increasing_id()))
    n_asked, cores = asked.count(), asked.sparkSession.sparkContext.defaultParallelism
    n_blocks = -(-max(1, -(-n_asked // BLOCK), min(2 * cores, -(-n_asked // 256))) // cores) * cores if n_asked > 256 else 1
    weight = F.lit(1.0) if flat else F.col("idf")
    terms = asked.select("q", F.explode("bag").alias("term")).groupBy("q", "term").agg(F.count("*").alias("qtf")).join(index.idf, "term")
    terms = terms.groupBy("q").agg(F.array_sort(F.collect_list(F.struct((-F.col("df")).alias("o"), "term", F.col("qtf").cast("int").alias("qtf"), weight.alias("idf")))).alias("terms"))
    often = F.filter("terms", lambda t: t["o"] * -COMMON > index.n)
    by = asked.select("q", (F.col(within).cast("string") if within else F.lit(None).cast("string")).alias("scope")).join(terms, "q").select("q", "scope", "terms", F.size(often).alias("common"), F.to_json(F.transform(often, lambda t: F.struct(t["term"], t["qtf"]))).alias("sig"))
    by = by.repartitionByRange(n_blocks, "sig", "scope", "q").sortWithinPartitions("sig", "scope", "q").drop("sig")
    blocks = checkpointed(by.mapInArrow(_blocked, "qs binary, q_scopes array<string>, q_vocab array<string>, idf array<double>, q_ptr binary, codes binary, qtf binary, common binary"))
    groups = -(-2 * cores // n_blocks)
    pairs = index.parts.coalesce(groups).hint("shuffle_replicate_nl").crossJoin(blocks)
    run = _searched(k, index.avgdl, bool(within), flat, shared)
    found = pairs.mapInArrow(run, f"q bigint, {index.key} {index.kind}, score double, shared int")
    w = Window.partitionBy("q").orderBy(F.desc("score"), index.key)
    best = found.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= k)
    best = best if shared else best.drop("shared")
    return bags.join(asked, ["bag", *scope]).select(query_key, *carry, "q").distinct().join(best, "q").drop("q")


def _packed(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """One row for each PART documents of a partition: their postings by term."""
    held, docs, words = [], 0, 0
    for batch in batches:
        for at in range(0, batch.num_rows, SLICE):
            b = batch.slice(at, SLICE)
            if held and (docs + b.num_rows > PART or words > PART_WORDS):
                yield _part(held)
                held, docs, words = [], 0, 0
            held.append(b)
            docs, words = docs + b.num_rows, words + (pc.sum(pc.list_value_length(b["words"])).as_py() or 0)
    if held:
        yield _part(held)


def _part(held: list[pa.RecordBatch]) -> pa.RecordBatch:
    t = pa.Table.from_batches(held)
    t = t.take(pc.sort_indices(t, sort_keys=[("key", "ascending")])).combine_chunks()
    keys, scopes, words = (pa.concat_arrays(t[c].chunks) for c in ("key", "scope", "words"))
    dl = pc.fill_null(pc.list_value_length(words), 0).to_numpy(zero_copy_only=False)
    coded = words.flatten().dictionary_encode()
    code = coded.indices.to_numpy(zero_copy_only=False).astype(np.int64)
    both, tf = np.unique(code * PART + np.repeat(np.arange(len(dl)), dl), return_counts=True)
    term, doc, size = both // PART, both % PART, len(coded.dictionary)
    df = np.bincount(term, minlength=size)
    # Documents without a key come last. They count, but can't be found.
    n_found = len(keys) - keys.null_count
    term, doc, tf = (x[doc < n_found] for x in (term, doc, tf))
    ptr = np.concatenate([[0], np.cumsum(np.bincount(term, minlength=size))])
    tf = tf.astype(np.uint16 if not len(tf) or tf.max() < 65_536 else np.uint32)
    one = lambda x: pa.ListArray.from_arrays(pa.array([0, len(x)], pa.int32()), x)
    raw = lambda x, kind: pa.array([x.astype(kind).tobytes()], pa.binary())
    columns = [pa.array([len(dl)], pa.int64()), pa.array([int(dl.sum())], pa.int64()), one(keys[:n_found]), one(scopes[:n_found]), one(coded.dictionary), one(pa.array(df, pa.int32())), raw(ptr, np.int32), raw(doc, np.uint16), raw(tf, tf.dtype), raw(dl[:n_found], np.int32)]
    return pa.RecordBatch.from_arrays(columns, ["n", "total", "keys", "scopes", "vocab", "df", "ptr", "docs", "tf", "dl"])


def _blocked(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """One row for each BLOCK queries of a partition, in their order."""
    held, rows = [], 0
    for batch in batches:
        for at in range(0, batch.num_rows, BLOCK):
            b = batch.slice(at, BLOCK)
            if held and rows + b.num_rows > BLOCK:
                yield _block(held)
                held, rows = [], 0
            held.append(b)
            rows += b.num_rows
    if held:
        yield _block(held)


def _block(held: list[pa.RecordBatch]) -> pa.RecordBatch:
    t = pa.Table.from_batches(held)
    q, scopes, terms, common = (pa.concat_arrays(t[c].chunks) for c in ("q", "scope", "terms", "common"))
    each = terms.flatten()
    coded = each.field("term").dictionary_encode()
    codes = coded.indices.to_numpy(zero_copy_only=False)
    idf = np.zeros(len(coded.dictionary))
    idf[codes] = each.field("idf").to_numpy(zero_copy_only=False)
    one = lambda x: pa.ListArray.from_arrays(pa.array([0, len(x)], pa.int32()), x)
    raw = lambda x, kind: pa.array([np.asarray(x).astype(kind).tobytes()], pa.binary())
    ptr = np.concatenate([[0], np.cumsum(pc.list_value_length(terms).to_numpy(zero_copy_only=False))])
    columns = [raw(q, np.int64), one(scopes), one(coded.dictionary), one(pa.array(idf)), raw(ptr, np.int32), raw(codes, np.int32), raw(each.field("qtf"), np.int32), raw(common, np.int32)]
    return pa.RecordBatch.from_arrays(columns, ["qs", "q_scopes", "q_vocab", "idf", "q_ptr", "codes", "qtf", "common"])


def _first(score: np.ndarray, k: int) -> np.ndarray:
    """Places of the k greatest values, equal ones in their order."""
    if len(score) <= k:
        return np.arange(len(score))
    least = np.partition(score, len(score) - k)[len(score) - k]
    above = np.flatnonzero(score > least)
    return np.concatenate([above, np.flatnonzero(score == least)[: k - len(above)]])


def _searched(k: int, avgdl: float, scoped: bool, flat: bool, shared: bool):
    """The function of a task: parts stream past the blocks; what any part found so far is the floor in the next ones."""

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        states: dict[bytes, SimpleNamespace] = {}
        for batch in batches:
            for i in range(batch.num_rows):
                row = {c: batch[c][i] for c in batch.schema.names}
                at = row["qs"].as_py()
                if at not in states:
                    states[at] = SimpleNamespace(q=np.frombuffer(at, np.int64), top=np.full((len(at) // 8, k), -np.inf), found=[])
                _meet(row, states[at], k, avgdl, scoped, flat, shared)
        for s in states.values():
            floor = s.top.min(axis=1)
            for i, keys, score, n_shared in s.found:
                keep = score >= floor[i]
                yield pa.RecordBatch.from_arrays([pa.array(s.q[i[keep]]), keys.filter(pa.array(keep)), pa.array(score[keep]), pa.array(n_shared[keep])], names)

    names = ["q", "key", "score", "shared"]
    return run


def _meet(row: dict, state: SimpleNamespace, k: int, avgdl: float, scoped: bool, flat: bool, shared: bool) -> None:
    """Adds what a block of queries finds in a part: per query at most k documents that reach its floor."""
    bits = lambda c, kind: np.frombuffer(row[c].as_buffer(), kind)
    ptr, place, dl = bits("ptr", np.int32), bits("docs", np.uint16), bits("dl", np.int32)
    tf = bits("tf", np.uint16 if row["tf"].as_buffer().size == 2 * len(place) else np.uint32)
    keys, n = row["keys"].values, len(dl)
    known = pc.fill_null(pc.index_in(row["q_vocab"].values, value_set=row["vocab"].values), -1).to_numpy(zero_copy_only=False)
    idf, norm = row["idf"].values.to_numpy(zero_copy_only=False), K1 * (1 - B + B * dl / (avgdl or 1.0))
    docs, part = [None] * len(idf), [None] * len(idf)
    for v, at in enumerate(known):
        if at >= 0 and ptr[at] < ptr[at + 1]:
            here = slice(ptr[at], ptr[at + 1])
            docs[v] = place[here].astype(np.intp)
            f = tf[here].astype(np.float64)
            part[v] = np.full(len(f), idf[v]) if flat else idf[v] * f * (K1 + 1) / (f + norm[docs[v]])
    q_ptr, codes, qtf, common = bits("q_ptr", np.int32).tolist(), bits("codes", np.int32).tolist(), bits("qtf", np.int32).tolist(), bits("common", np.int32).tolist()
    odd = [x <= 0 for x in idf.tolist()]
    if scoped:
        asked = row["q_scopes"].values.to_pylist()
        coded = row["scopes"].values.dictionary_encode()
        scope_of = {s: c for c, s in enumerate(coded.dictionary.to_pylist())}
        scope = pc.fill_null(coded.indices, -1).to_numpy(zero_copy_only=False)
    floors, new = state.top.min(axis=1), np.full(state.top.shape, -np.inf)
    buffer, zero = np.zeros(n), np.zeros(n)
    chosen, scores, number, count = [], [], [], []
    path, sums = [], [zero]  # the common terms of the query at hand, and the sums of each start of them
    group = None

    for i in range(len(q_ptr) - 1):
        mine = [(codes[j], qtf[j]) for j in range(q_ptr[i], q_ptr[i + 1])]
        inside = None
        if scoped:
            inside = scope_of.get(asked[i])
            if inside is None:
                continue
        if any(odd[v] for v, _ in mine):
            # A part of 0 or less, in a small corpus only: all documents with a word are scored.
            s, hit = np.zeros(n), np.zeros(n, bool)
            for v, m in mine:
                if docs[v] is not None:
                    s[docs[v]] += part[v] * m
                    hit[docs[v]] = True
            idx = np.flatnonzero(hit if inside is None else hit & (scope == inside))
            s = s[idx]
        else:
            often = [x for x in mine[: common[i]] if docs[x[0]] is not None]
            if (often, inside) != group:
                same = 0
                while same < min(len(often), len(path)) and often[same] == path[same]:
                    same += 1
                path, sums = often, sums[: same + 1]
                for v, m in often[same:]:
                    s = sums[-1].copy()
                    s[docs[v]] += part[v] * m if m > 1 else part[v]
                    sums.append(s)
                base, group, low = sums[-1], (often, inside), None
            # The best by the common terms alone; those found for a lower floor hold for a higher one.
            if low is None or floors[i] < low:
                low = floors[i]
                lead = np.flatnonzero((base > 0) & (base >= low - 1e-6)) if often else np.zeros(0, np.intp)
                lead = lead if inside is None else lead[scope[lead] == inside]
                lead = np.sort(lead[_first(np.round(base[lead], 6), k)])
            rare = [x for x in mine[common[i] :] if docs[x[0]] is not None]
            if rare:
                for v, m in rare:
                    buffer[docs[v]] += part[v] * m if m > 1 else part[v]
                idx = np.concatenate([docs[v] for v, _ in rare] + [lead])
                s = base[idx] + buffer[idx]
                for v, _ in rare:
                    buffer[docs[v]] = 0.0
                keep = s >= floors[i] - 1e-6
                if inside is not None:
                    keep &= scope[idx] == inside
                idx, at = np.unique(idx[keep], return_index=True)
                s = s[keep][at]
            else:
                idx, s = lead, base[lead]
        s = np.round(s, 6)
        keep = s >= floors[i]
        idx, s = idx[keep], s[keep]
        if not len(idx):
            continue
        at = _first(s, k)
        idx, s = idx[at], s[at]
        new[i, : len(s)] = s
        chosen.append(idx)
        scores.append(s)
        number.append(i)
        both = np.zeros(len(idx), np.int32)
        if shared:
            for v, _ in mine:
                if docs[v] is not None:
                    at = np.searchsorted(docs[v], idx)
                    both += docs[v][np.minimum(at, len(docs[v]) - 1)] == idx
        count.append(both)
    if chosen:
        sizes = [len(x) for x in chosen]
        state.found.append((np.repeat(number, sizes), keys.take(pa.array(np.concatenate(chosen))), np.concatenate(scores), np.concatenate(count)))
        state.top = np.partition(np.concatenate([state.top, new], axis=1), k, axis=1)[:, k:]
