"""Retrieval as joins: BM25 over postings, exact cosine top-k in blocks, rank fusion, candidate pools, acceptance."""

from __future__ import annotations

import uuid
from collections.abc import Iterator

import numpy as np
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from occura.shared import written

# BM25 and fusion constants, pool sizes.
K1, B = 1.2, 0.75
RRF_K = 60
POOL, RESERVED, RESERVED_WITH_FACETS, PREFERRED, FACET_QUOTA = 50, 20, 10, 30, 10
#: Vectors of one block; a task compares one block of queries with one block of rows.
BLOCK = 1024
DIGITS = 6


def postings(documents: DataFrame, ident: str, terms: Column) -> DataFrame:
    """(doc_id, term, tf, length) of every document with terms."""
    words = documents.select(F.col(ident).alias("doc_id"), terms.alias("ts")).where(F.size("ts") > 0)
    each = words.select("doc_id", F.size("ts").alias("length"), F.explode("ts").alias("term"))
    return each.groupBy("doc_id", "term", "length").agg(F.count("*").alias("tf"))


def bm25(queries: DataFrame, index: DataFrame) -> DataFrame:
    """(query_id, doc_id, score) of all pairs that share a term. ``queries``: (query_id, term), each term once.

    N, document frequencies and the mean length cover the whole index. Only terms that some query has are joined
    (a semi join before the postings are weighted), and the sum is partial before its shuffle.
    """
    weighted = _weighted(index, queries.select("term").distinct())
    return queries.join(weighted, "term").groupBy("query_id", "doc_id").agg(F.round(F.sum("w"), DIGITS).alias("score"))


def _weighted(index: DataFrame, wanted: DataFrame) -> DataFrame:
    """(term, doc_id, w) of the postings whose term some query has."""
    stats = index.select("doc_id", "length").distinct().agg(F.count("*").alias("n_docs"), F.avg("length").alias("mean_length"))
    hit = index.join(wanted, "term", "left_semi")
    df = hit.groupBy("term").agg(F.count("*").alias("df"))
    idf = F.log(1 + (F.col("n_docs") - F.col("df") + 0.5) / (F.col("df") + 0.5))
    saturation = F.col("tf") / (F.col("tf") + K1 * (1 - B + B * F.col("length") / F.col("mean_length")))
    return hit.join(df, "term").join(F.broadcast(stats)).select("term", "doc_id", (idf * saturation).alias("w"))


#: Queries and documents of one block, and posting matches that are expanded at once.
QUERY_BLOCK, DOCUMENT_BLOCK, EXPANDED = 4096, 65_536, 2_000_000
#: Inverted lists of so many documents are added up one by one, shorter ones together.
LONG = 1500
#: Documents that one task adds up, block after block, before it hands on k of them a query.
DOCUMENTS_A_TASK = 16 * DOCUMENT_BLOCK


def _once(value: Column) -> Column:
    """A column that filters and projections above it do not work out again."""
    return F.explode(F.array(value))


def profiles(documents: DataFrame, ident: str, terms: Column, *also: str) -> DataFrame:
    """(doc_id, length, ts, tfs, lens, *also) of every document with terms; ``terms`` has each term once, and ids are unique."""
    ts = documents.select(F.col(ident).cast("string").alias("doc_id"), _once(F.transform(terms, lambda t: F.xxhash64(t))).alias("ts"), *also).where(F.size("ts") > 0)
    return ts.select("doc_id", F.size("ts").alias("length"), "ts", F.array_repeat(F.lit(1), F.size("ts")).alias("tfs"), F.lit(None).cast("array<int>").alias("lens"), *also)


def counted_profiles(wordings: DataFrame, ident: str, terms: Column, *also: str) -> DataFrame:
    """The same for documents of any number of wordings: lengths and term counts are sums over a document's rows.
    ``also`` may name ``kinds``, which is alike on all rows of a document.

    A task reads its documents' rows in order and holds the distinct terms of one batch and one document, never the wordings.
    """

    def run(batches: Iterator) -> Iterator:
        import pyarrow as pa

        empty = np.zeros(0, np.int64)
        last, terms_of, counts_of, kinds_of_last = None, empty, empty, None  # the document that the next batch may go on with

        def out(ids: list, sizes: np.ndarray, lengths: np.ndarray, ts: np.ndarray, tfs: np.ndarray, kinds: list) -> pa.RecordBatch:
            at = pa.array(np.concatenate([[0], np.cumsum(sizes)]), pa.int32())
            columns = [pa.array(ids, pa.string()), pa.array(lengths, pa.int32()), pa.ListArray.from_arrays(at, pa.array(ts, pa.int64())), pa.ListArray.from_arrays(at, pa.array(tfs, pa.int32())), pa.nulls(len(ids), pa.list_(pa.int32()))]
            columns += [pa.array(kinds, pa.list_(pa.int64()))] * len(also)
            return pa.RecordBatch.from_arrays(columns, names=["doc_id", "length", "ts", "tfs", "lens", *also])

        for b in batches:
            ids = np.array(b.column(0).to_pylist(), object)
            starts = np.flatnonzero(np.concatenate([[True], ids[1:] != ids[:-1]])) if len(ids) else empty
            if not len(ids):
                continue
            run_of = np.cumsum(np.bincount(starts, minlength=len(ids))) - 1
            t = b.column(1).flatten().to_numpy()
            of = np.repeat(run_of, b.column(1).value_lengths().to_numpy())
            n = np.ones(len(t), np.int64)
            names = list(ids[starts])
            kinds = b.column(2).take(pa.array(starts)).to_pylist() if also else [None] * len(names)
            if last is not None and names[0] != last:
                names, of, kinds = [last, *names], of + 1, [kinds_of_last, *kinds]
            of, t, n = np.concatenate([np.zeros(len(terms_of), np.int64), of]), np.concatenate([terms_of, t]), np.concatenate([counts_of, n])
            order = np.lexsort((t, of))
            of, t, n = of[order], t[order], n[order]
            first = np.flatnonzero(np.concatenate([[True], (of[1:] != of[:-1]) | (t[1:] != t[:-1])])) if len(t) else empty
            of, t, n = of[first], t[first], np.add.reduceat(n, first) if len(first) else empty
            done = int(np.searchsorted(of, len(names) - 1))
            last, terms_of, counts_of, kinds_of_last = names[-1], t[done:], n[done:], kinds[-1]
            if done:
                sizes = np.bincount(of[:done], minlength=len(names) - 1)
                lengths = np.bincount(of[:done], weights=n[:done], minlength=len(names) - 1).astype(np.int64)
                kept = np.flatnonzero(sizes)
                yield out([names[i] for i in kept], sizes[kept], lengths[kept], t[:done], n[:done], [kinds[i] for i in kept])
        if len(terms_of):
            yield out([last], np.array([len(terms_of)]), np.array([counts_of.sum()]), terms_of, counts_of, [kinds_of_last])

    rows = wordings.repartition(ident).sortWithinPartitions(ident).select(F.col(ident).cast("string").alias("doc_id"), _once(F.transform(terms, lambda t: F.xxhash64(t))).alias("ts"), *also).where(F.size("ts") > 0)
    return rows.mapInArrow(run, "doc_id string, length int, ts array<bigint>, tfs array<int>, lens array<int>" + ", kinds array<bigint>" * len(also))


def profiles_of(index: DataFrame) -> DataFrame:
    """Profiles of postings (doc_id, term, tf, length); a document's postings may be of several lengths."""
    each = F.struct(F.xxhash64("term").alias("t"), F.col("tf").cast("int").alias("tf"), F.col("length").cast("int").alias("length"))
    rows = index.groupBy("doc_id").agg(F.collect_list(each).alias("x"), F.min("length").alias("low"), F.max("length").alias("high"))
    return rows.select("doc_id", F.col("low").cast("int").alias("length"), F.col("x.t").alias("ts"), F.col("x.tf").alias("tfs"), F.when(F.col("low") < F.col("high"), F.col("x.length")).alias("lens"))


def _lists_of(at: np.ndarray, values: np.ndarray) -> list:
    return [values[a:b] for a, b in zip(at[:-1], at[1:], strict=True)]


def _document_blocks(rows: DataFrame, mean_length: float) -> DataFrame:
    """Packs (doc_id, length, ts, tfs, lens, kinds) into inverted lists of DOCUMENT_BLOCK documents, in the order of their ids.

    A list has a document's place and count; what a length does to a count is kept once a document. ``dsat`` has the
    weight of every posting instead, where postings of one document differ in length.
    """
    names = ("dids", "dkey", "dterms", "dat", "ddocs", "dtfs", "dnorm", "dsat", "dkindof", "dkinds")
    size = DOCUMENT_BLOCK

    def block(parts: list):
        import pyarrow as pa

        ids = pa.concat_arrays([p.column(0) for p in parts])
        order = np.argsort(np.array([x or "" for x in ids.to_pylist()], object), kind="stable")
        place = np.empty(len(order), np.int64)
        place[order] = np.arange(len(order))
        whole = lambda c: pa.concat_arrays([p.column(c) for p in parts])
        length = whole(1).to_numpy().astype(np.float64)
        per = whole(2).value_lengths().to_numpy().astype(np.int64)
        doc = np.repeat(place, per)
        t, tf = whole(2).flatten().to_numpy(), whole(3).flatten().to_numpy()
        by = np.lexsort((doc, t))
        t, tf = t[by], tf[by]
        first = np.flatnonzero(np.concatenate([[True], t[1:] != t[:-1]]))
        norm = np.empty(len(order))
        norm[place] = K1 * (1 - B + B * length / mean_length)
        sat = b""
        lens = whole(4)
        if lens.null_count < len(lens):
            own = np.repeat(length, per)
            own[np.repeat(lens.is_valid().to_numpy(zero_copy_only=False), per)] = lens.drop_null().flatten().to_numpy()
            sat = (tf / (tf + K1 * (1 - B + B * own[by] / mean_length))).tobytes()
        kinds = whole(5)
        kind_of = np.repeat(place, kinds.fill_null([]).value_lengths().to_numpy().astype(np.int64)) if kinds.null_count < len(kinds) else np.zeros(0, np.int64)
        data = [t[first], np.append(first, len(t)).astype(np.int64), doc[by].astype(np.uint16), tf.astype(np.int32) if (tf != 1).any() else np.zeros(0, np.int32), norm]
        blob = [uuid.uuid4().bytes, *[x.tobytes() for x in data], sat, kind_of.astype(np.int64).tobytes(), kinds.drop_null().flatten().to_numpy().astype(np.int64).tobytes()]
        return pa.RecordBatch.from_arrays([pa.array([ids.take(pa.array(order)).to_pylist()], pa.list_(pa.string())), *[pa.array([x], pa.binary()) for x in blob]], names=list(names))

    def run(batches: Iterator) -> Iterator:
        parts, n = [], 0
        for b in batches:
            while b.num_rows:
                head = b.slice(0, size - n)
                parts.append(head)
                n += head.num_rows
                b = b.slice(head.num_rows)
                if n == size:
                    yield block(parts)
                    parts, n = [], 0
        if parts:
            yield block(parts)

    return rows.select("doc_id", "length", "ts", "tfs", "lens", "kinds").mapInArrow(run, ", ".join(["dids array<string>", *[f"{n} binary" for n in names[1:]]]))


def _with_idfs(rows: DataFrame, vocabulary: tuple[np.ndarray, np.ndarray]) -> DataFrame:
    """(query_id, ts, idfs, kinds) of (query_id, ts, kinds): the terms that the sorted vocabulary has, with its weights."""
    words, weights = vocabulary

    def run(batches: Iterator) -> Iterator:
        import pyarrow as pa

        for b in batches:
            ts = b.column(1)
            t = ts.flatten().to_numpy()
            of = np.repeat(np.arange(b.num_rows), ts.value_lengths().to_numpy().astype(np.int64))
            place = np.minimum(np.searchsorted(words, t), max(len(words) - 1, 0))
            known = words[place] == t if len(words) else np.zeros(len(t), bool)
            at = pa.array(np.concatenate([[0], np.cumsum(np.bincount(of[known], minlength=b.num_rows))]), pa.int32())
            yield pa.RecordBatch.from_arrays([b.column(0), pa.ListArray.from_arrays(at, pa.array(t[known])), pa.ListArray.from_arrays(at, pa.array(weights[place[known]])), b.column(2)], names=["query_id", "ts", "idfs", "kinds"])

    return rows.select(F.col("query_id").cast("string"), "ts", "kinds").mapInArrow(run, "query_id string, ts array<bigint>, idfs array<double>, kinds array<bigint>")


def _query_blocks(rows: DataFrame) -> DataFrame:
    """Packs (query_id, ts, idfs, kinds) into blocks of at most QUERY_BLOCK queries."""
    names = ("qids", "qat", "qterms", "qidfs", "qkindat", "qkinds")
    size = QUERY_BLOCK

    def run(batches: Iterator) -> Iterator:
        import pyarrow as pa

        for whole in batches:
            for begin in range(0, whole.num_rows, size):
                b = whole.slice(begin, size)
                at = lambda c: np.concatenate([[0], np.cumsum(b.column(c).fill_null([]).value_lengths().to_numpy())]).astype(np.int64).tobytes()  # noqa: E731, B023
                flat = lambda c, t: b.column(c).fill_null([]).flatten().to_numpy().astype(t).tobytes()  # noqa: E731, B023
                blob = [at(1), flat(1, np.int64), flat(2, np.float64), at(3), flat(3, np.int64)]
                yield pa.RecordBatch.from_arrays([pa.array([b.column(0).to_pylist()], pa.list_(pa.string())), *[pa.array([x], pa.binary()) for x in blob]], names=list(names))

    return rows.select("query_id", "ts", "idfs", "kinds").mapInArrow(run, ", ".join(["qids array<string>", *[f"{n} binary" for n in names[1:]]]))


class _Best:
    """The k best (score, document) of one list of one query over the blocks seen so far; equal scores by id."""

    def __init__(self, k: int) -> None:
        self.k, self.least = k, 0.0
        self.scores, self.documents = np.zeros(0), np.zeros(0, np.int64)

    def add(self, total: np.ndarray, docs: np.ndarray | None, base: int, name) -> None:
        """Documents of a block lie in the order of their ids; ``docs`` are those that may be taken."""
        mine = total if docs is None else total[docs]
        least = self.least
        if not least and len(mine) > 64 * self.k:  # the k-th best of any part is no better than the k-th best of all
            part = mine[::16]
            least = np.partition(part, len(part) - self.k)[len(part) - self.k]
        at = np.flatnonzero(mine > max(least - 10.0**-DIGITS, 0))
        if not len(at):
            return
        s = np.round(mine[at], DIGITS)
        if len(s) > self.k:
            kth = max(np.partition(s, len(s) - self.k)[len(s) - self.k], self.least)
            taken = np.flatnonzero(s > kth)
            taken = np.sort(np.concatenate([taken, np.flatnonzero(s == kth)[: self.k - len(taken)]]))
            at, s = at[taken], s[taken]
        elif self.least > 0:
            taken = s >= self.least
            at, s = at[taken], s[taken]
        if not len(s):
            return
        s, d = np.concatenate([self.scores, s]), np.concatenate([self.documents, (at if docs is None else docs[at]) + base])
        if len(s) > self.k:
            kth = np.partition(s, len(s) - self.k)[len(s) - self.k]
            sure, tied = np.flatnonzero(s > kth), np.flatnonzero(s == kth)
            room = self.k - len(sure)
            if len(tied) > room:
                tied = np.array(sorted(tied, key=lambda i: name(d[i]))[:room], np.int64)
            taken = np.concatenate([sure, tied])
            s, d = s[taken], d[taken]
        self.scores, self.documents = s, d
        if len(s) == self.k:
            self.least = s.min()


def kinds_of(kinds: DataFrame) -> DataFrame:
    """(id, kinds) of (id, kind): what :func:`search` compares."""
    return kinds.toDF("id", "kind").where("kind IS NOT NULL").groupBy("id").agg(F.collect_set(F.xxhash64("kind")).alias("kinds"))


class Found:
    """The lists of one search: ``rows`` has (query_id, found), a compressed row a query and task of documents."""

    def __init__(self, rows: DataFrame, lists: list[tuple[str, int, int | None, bool]], whole: bool) -> None:
        self.rows, self.lists, self.whole = rows, lists, whole


def _packed_lists(lists: list[tuple[list, np.ndarray]]) -> bytes:
    """Ids and scores (whole numbers of 10 ** -DIGITS) of the lists of one query."""
    import pyarrow as pa

    ids = [None if i is None else i.encode() for own, _ in lists for i in own]
    head = np.array([len(lists), *[len(own) for own, _ in lists], *[-1 if i is None else len(i) for i in ids]], np.int32)
    scores = np.concatenate([np.diff(np.rint(s * 10**DIGITS).astype(np.int64), prepend=0) for _, s in lists])
    plain = head.tobytes() + scores.tobytes() + b"".join(i for i in ids if i is not None)
    return len(plain).to_bytes(8, "little") + pa.compress(plain, codec="zstd", asbytes=True)


def _unpacked_lists(blob: bytes) -> list[tuple[list, np.ndarray]]:
    import pyarrow as pa

    plain = pa.decompress(blob[8:], int.from_bytes(blob[:8], "little"), codec="zstd", asbytes=True)
    count = int(np.frombuffer(plain, np.int32, 1)[0])
    sizes = np.frombuffer(plain, np.int32, count, 4)
    total = int(sizes.sum())
    lengths = np.frombuffer(plain, np.int32, total, 4 + 4 * count).tolist()
    scores = np.frombuffer(plain, np.int64, total, 4 + 4 * count + 4 * total)
    at, ids = 4 + 4 * count + 12 * total, []
    for n in lengths:
        ids.append(None if n < 0 else plain[at : at + n].decode())
        at += max(n, 0)
    out, begin = [], 0
    for n in sizes.tolist():
        out.append((ids[begin : begin + n], np.cumsum(scores[begin : begin + n]) / 10**DIGITS))
        begin += n
    return out


def _in_order(ids: list, scores: np.ndarray, k: int) -> tuple[list, np.ndarray]:
    order = sorted(range(len(ids)), key=lambda i: (-scores[i], ids[i] or ""))[:k]
    return [ids[i] for i in order], scores[order]


def gathered(fields: list[Found], make, schema: str) -> DataFrame:
    """Rows that ``make`` makes of all lists of a query; ``make`` gets a list a field of {stage: (ids, scores)}, each best
    first, and returns columns without the query's id, which comes first in ``schema``.

    Lists of one search that one task has made are final and are not shuffled; else compressed rows are, once.
    """
    import functools

    specs = [f.lists for f in fields]
    rows = functools.reduce(DataFrame.unionByName, [f.rows.withColumn("field", F.lit(n)) for n, f in enumerate(fields)])
    if len(fields) > 1 or not fields[0].whole:
        rows = rows.repartition("query_id").sortWithinPartitions("query_id")

    def run(batches: Iterator) -> Iterator:
        import pyarrow as pa

        def lists_of(own: list[tuple[int, bytes]]) -> list[dict]:
            out: list[dict] = [{} for _ in specs]
            for n, spec in enumerate(specs):
                parts = [_unpacked_lists(blob) for field, blob in own if field == n]
                for i, (stage, k, _, _) in enumerate(spec):
                    if len(parts) == 1:
                        out[n][stage] = parts[0][i]
                    elif parts:
                        out[n][stage] = _in_order([x for p in parts for x in p[i][0]], np.concatenate([p[i][1] for p in parts]), k)
                    else:
                        out[n][stage] = ([], np.zeros(0))
            return out

        query, own, done = None, [], []

        def batch() -> pa.RecordBatch:
            columns = [[q for q, c in done for _ in range(len(c[0]))]]
            columns += [[x for _, c in done for x in c[j]] for j in range(len(types) - 1)]
            return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, types, strict=True)], names=names)

        for b in batches:
            for q, field, blob in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), b.column(2), strict=True):
                if own and q != query:
                    done.append((query, make(lists_of(own))))
                    own = []
                    if len(done) == 256:
                        yield batch()
                        done = []
                query = q
                own.append((field, blob.as_py()))
        if own:
            done.append((query, make(lists_of(own))))
        if done:
            yield batch()

    import pyarrow as pa

    kinds = {"string": pa.string(), "double": pa.float64(), "long": pa.int64()}
    names, types = zip(*[(c.split()[0], kinds[c.split()[1]]) for c in schema.split(", ")], strict=True)
    return rows.select("query_id", "field", "found").mapInArrow(run, schema)


def search(queries: DataFrame, index: DataFrame, lists: list[tuple[str, int, int | None, bool]], kinds: DataFrame | None = None) -> DataFrame:
    """(query_id, stage, doc_id, score, rank): the lists of :func:`find`, a row a document."""

    def make(fields: list[dict]) -> tuple:
        own = fields[0]
        stages = [stage for stage, (ids, _) in own.items() for _ in ids]
        return stages, [x for ids, _ in own.values() for x in ids], [x for _, s in own.values() for x in s.tolist()], [r for ids, _ in own.values() for r in range(1, len(ids) + 1)]

    return gathered([find(queries, index, lists, kinds)], make, "query_id string, stage string, doc_id string, score double, rank long")


#: Terms of which the driver holds the document frequencies; those of a larger vocabulary are joined to the queries.
VOCABULARY = 2_000_000


def find(queries: DataFrame, index: DataFrame, lists: list[tuple[str, int, int | None, bool]], kinds: DataFrame | None = None) -> Found:
    """Lists of the best documents of every query, all made in one pass.

    ``queries``: (query_id, ts); ``index``: :func:`profiles`, which is read several times and should be a table. A list
    is (stage, k, half, same): the k best by all terms of the query or, with ``half``, by those whose hash has this last
    bit; with ``same`` only documents of a kind that the query has in ``kinds`` (id, kind) compete, chosen before the
    cut to k. Queries or an index that have the column ``kinds`` of :func:`kinds_of` are not joined again. N, document frequencies and the mean length always cover the whole index.

    Documents are packed into blocks of inverted lists, queries into blocks. A task adds up its queries over one block
    of documents after another and keeps k documents a query, so what is shuffled is k a query, however many documents
    share a term with it.
    """
    spark = index.sparkSession
    stats = index.agg(F.count("*").alias("rows"), F.sum(F.when(F.col("lens").isNull(), 1).otherwise(F.size(F.array_distinct("lens")))).alias("n"), F.sum(F.when(F.col("lens").isNull(), F.col("length")).otherwise(F.aggregate(F.array_distinct("lens"), F.lit(0), lambda a, x: a + x))).alias("total")).first()
    n_docs, mean_length = stats["n"] or 0, (stats["total"] or 0) / max(stats["n"] or 0, 1)
    parts = min(int(spark.conf.get("spark.sql.shuffle.partitions")), max(12, 4 * spark.sparkContext.defaultParallelism))

    df = index.select(F.explode("ts").alias("t")).groupBy("t").agg(F.count("*").alias("df"))
    idf = F.log(1 + (F.lit(n_docs) - F.col("df") + 0.5) / (F.col("df") + 0.5))
    of = kinds_of(kinds) if kinds is not None else None
    asked, documents = queries, index
    if "kinds" not in queries.columns:
        asked = asked.withColumn("kinds", F.lit(None).cast("array<bigint>")) if of is None else asked.join(of.withColumnRenamed("id", "query_id"), "query_id", "left")
    if "kinds" not in index.columns:
        documents = index.withColumn("kinds", F.lit(None).cast("array<bigint>")) if of is None else index.join(of.withColumnRenamed("id", "doc_id"), "doc_id", "left")
    known = df.limit(VOCABULARY + 1).select("t", idf.alias("idf")).toArrow()
    if known.num_rows <= VOCABULARY:
        words, weights = known.column("t").to_numpy(), known.column("idf").to_numpy()
        order = np.argsort(words)
        asked = _with_idfs(asked.repartition(parts, "query_id"), (words[order], weights[order]))
    else:
        terms = asked.select("query_id", F.explode("ts").alias("t")).join(df, "t").select("query_id", F.struct("t", idf.alias("idf")).alias("x"))
        found_terms = terms.repartition(parts, "query_id").groupBy("query_id").agg(F.collect_list("x").alias("x"))
        asked = found_terms.join(asked.select("query_id", "kinds"), "query_id").select("query_id", F.col("x.t").alias("ts"), F.col("x.idf").alias("idfs"), "kinds").repartition(parts, "query_id")
    tasks = max(1, -(-stats["rows"] // DOCUMENTS_A_TASK))
    packed = _document_blocks(documents.coalesce(max(1, -(-stats["rows"] // DOCUMENT_BLOCK))), mean_length).repartition(tasks)
    pairs = packed.hint("shuffle_replicate_nl").crossJoin(_query_blocks(asked))  # blocks of all rows, streamed, against blocks of a stated query set
    expanded = EXPANDED

    def score(batches: Iterator) -> Iterator:
        import pyarrow as pa

        states: dict[str, tuple] = {}
        names: list = []
        bases: list[int] = [0]
        opened, block = None, None

        def name(document: int) -> str:
            i = int(np.searchsorted(bases, document, "right")) - 1
            return names[i][int(document) - bases[i]].as_py() or ""

        for b in batches:
            for i in range(b.num_rows):
                get = lambda c, t: np.frombuffer(b.column(c)[i].as_buffer(), t)  # noqa: E731, B023
                key = b.column("dkey")[i].as_py()
                if key != opened:
                    opened = key
                    ids = b.column("dids")[i].values
                    names.append(ids.take(pa.array(np.arange(len(ids)))))
                    bases.append(bases[-1] + len(ids))
                    docs, norm, sat = get("ddocs", np.uint16).astype(np.int64), get("dnorm", np.float64), get("dsat", np.float64)
                    once = None  # where every count is 1, one factor a document for its whole sum
                    if not len(sat):
                        tfs = get("dtfs", np.int32)
                        sat, once = (tfs / (tfs + norm[docs]), None) if len(tfs) else (None, 1 / (1 + norm))
                    kind_of, kind = get("dkindof", np.int64), get("dkinds", np.int64)
                    block = get("dterms", np.int64).copy(), get("dat", np.int64).copy(), docs, None if sat is None else sat.copy(), once, {x: np.sort(kind_of[kind == x]) for x in np.unique(kind)}
                terms, at, docs, sat, once, of_kind = block
                base, size = bases[-2], bases[-1] - bases[-2]
                qids = b.column("qids")[i].values
                first = qids[0].as_py()
                if first not in states:
                    qat, kat = get("qat", np.int64), get("qkindat", np.int64)
                    states[first] = qids.to_pylist(), _lists_of(qat, get("qterms", np.int64).copy()), _lists_of(qat, get("qidfs", np.float64).copy()), _lists_of(kat, get("qkinds", np.int64).copy()), [[_Best(k) for _, k, _, _ in lists] for _ in range(len(qids))]
                _, qts, qidfs, qkinds, bests = states[first]
                for ts, idfs, own, best in zip(qts, qidfs, qkinds, bests, strict=True):
                    places = np.minimum(np.searchsorted(terms, ts), len(terms) - 1)
                    known = terms[places] == ts

                    def total(chosen: np.ndarray) -> np.ndarray:
                        p, w = places[chosen], idfs[chosen]  # noqa: B023
                        lo, hi = at[p], at[p + 1]  # noqa: B023
                        if once is not None:  # noqa: B023
                            out = np.zeros(size)  # noqa: B023
                            for x, y, z in zip(lo.tolist(), hi.tolist(), w.tolist(), strict=True):
                                np.add.at(out, docs[x:y], z)  # noqa: B023
                            out *= once  # noqa: B023
                            return out
                        out, short = np.zeros(size), hi - lo < LONG  # noqa: B023
                        for x, y, z in zip(lo[~short].tolist(), hi[~short].tolist(), w[~short].tolist(), strict=True):
                            np.add.at(out, docs[x:y], sat[x:y] * z)  # noqa: B023
                        lo, hi, w, begin = lo[short], hi[short], w[short], 0
                        upto = np.cumsum(hi - lo)
                        while begin < len(lo):
                            stop = max(int(np.searchsorted(upto, (upto[begin - 1] if begin else 0) + expanded, "right")), begin + 1)
                            cut = list(zip(lo[begin:stop].tolist(), hi[begin:stop].tolist(), strict=True))
                            d = np.concatenate([docs[x:y] for x, y in cut])  # noqa: B023
                            s = np.concatenate([sat[x:y] for x, y in cut]) * np.repeat(w[begin:stop], (hi - lo)[begin:stop])  # noqa: B023
                            out += np.bincount(d, weights=s, minlength=size)  # noqa: B023
                            begin = stop
                        return out

                    halves = {h: total(known & ((ts & 1) == h)) for h in (0, 1)} if any(h is not None for _, _, h, _ in lists) else {}
                    halves[None] = halves[0] + halves[1] if halves else total(known)
                    alike = None
                    for (_, _, half, same), x in zip(lists, best, strict=True):
                        if not same:
                            x.add(halves[half], None, base, name)
                            continue
                        if alike is None:
                            found = [of_kind[v] for v in own.tolist() if v in of_kind]
                            alike = found[0] if len(found) == 1 else np.unique(np.concatenate(found)) if found else np.zeros(0, np.int64)
                        x.add(halves[half], alike, base, name)
        every = pa.concat_arrays(names) if names else None
        for qids, _, _, _, bests in states.values():
            for begin in range(0, len(qids), 256):
                here = []
                for q, best in zip(qids[begin : begin + 256], bests[begin : begin + 256], strict=True):
                    if any(len(x.scores) for x in best):
                        ids = every.take(pa.array(np.concatenate([x.documents for x in best]))).to_pylist()
                        cut = np.cumsum([0, *[len(x.scores) for x in best]])
                        here.append((q, _packed_lists([_in_order(ids[i:j], x.scores, x.k) for i, j, x in zip(cut[:-1], cut[1:], best, strict=True)])))
                if here:
                    yield pa.RecordBatch.from_arrays([pa.array([q for q, _ in here], pa.string()), pa.array([x for _, x in here], pa.binary())], names=["query_id", "found"])

    return Found(pairs.mapInArrow(score, "query_id string, found binary"), lists, tasks == 1)


def bm25_top_k(queries: DataFrame, fields: list[tuple[DataFrame, float]], k: int, kinds: DataFrame | None = None) -> DataFrame:
    """(query_id, doc_id, score, rank): the k best documents of every query; the best of several boosted fields counts.

    The same scores as :func:`bm25`, made for many queries by :func:`search`. Fields are postings or :func:`profiles`,
    ``queries`` (query_id, term) or (query_id, ts). A document among the k best by its best field is among the k best of
    that field, so each field is searched by itself. Ids are strings.

    With ``kinds``, (id, kind), a query ranks only the documents of its own kind. They are chosen before the cut to k;
    N, document frequencies and the mean length still cover the whole index.
    """
    asked = queries if "ts" in queries.columns else queries.groupBy("query_id").agg(F.collect_list(F.xxhash64("term")).alias("ts"))
    found = [find(asked, index if "ts" in index.columns else written(profiles_of(index), "profiles"), [("", k, None, kinds is not None)], kinds) for index, _ in fields]
    boosts = [boost for _, boost in fields]

    def make(lists: list[dict]) -> tuple:
        best: dict = {}
        for own, boost in zip(lists, boosts, strict=True):
            for ident, score in zip(own[""][0], (own[""][1] * boost).tolist(), strict=True):
                best[ident] = max(best.get(ident, score), score)
        ids, scores = _in_order(list(best), np.fromiter(best.values(), float, len(best)), k)
        return ids, scores.tolist(), range(1, len(ids) + 1)

    return gathered(found, make, "query_id string, doc_id string, score double, rank long")


def top_k(scores: DataFrame, k: int, group: str = "query_id", ident: str = "doc_id") -> DataFrame:
    """Adds the rank by score descending, then id, and keeps k per group (cut in every task before the shuffle)."""
    w = Window.partitionBy(group).orderBy(F.desc("score"), ident)
    return scores.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= k).withColumn("rank", F.col("rank").cast("long"))


def cosine_top_k(queries: DataFrame, rows: DataFrame, ident: str, vector: str, k: int, *, every_tie: bool = False) -> DataFrame:
    """(query_id, id, score, rank): the k rows nearest each query, itself left out, ties by id.

    With ``every_tie``: (query_id, id, score), the query itself too, and at least all rows that score no less than the
    k-th; the caller decides between them.

    Exact. Vectors are packed into blocks; a task multiplies a block of queries by a block of rows and hands on only
    k candidates a query, so what is shuffled is k per query and block. Vectors that are null, empty, zero or not finite
    are left out, before they are packed; a block holds vectors of one length, and only equal lengths are compared.
    Ids are whole numbers or strings.
    """
    kind = "string" if dict(rows.dtypes)[ident] == "string" else "long"

    def packed(df: DataFrame, names: tuple[str, str]) -> DataFrame:
        def run(batches: Iterator) -> Iterator:
            import pyarrow as pa

            by_length: dict[int, list] = {}

            def block(good: list) -> pa.RecordBatch:
                data = np.concatenate([v for _, v in good]).tobytes()
                return pa.RecordBatch.from_arrays([pa.array([[i for i, _ in good]], pa.list_(pa.string() if kind == "string" else pa.int64())), pa.array([data], pa.binary())], names=list(names))

            for b in batches:
                for i, x in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True):
                    v = np.asarray(() if x is None else x, np.float32)
                    if not np.isfinite(v).all() or not v.any():
                        continue
                    good = by_length.setdefault(len(v), [])
                    good.append((i, v))
                    if len(good) == BLOCK:
                        yield block(by_length.pop(len(v)))
            for good in by_length.values():
                yield block(good)

        return df.select(F.col(ident).cast(kind), vector).mapInArrow(run, f"{names[0]} array<{kind}>, {names[1]} binary")

    def compare(batches: Iterator) -> Iterator:
        import pyarrow as pa

        for b in batches:
            for r in b.to_pylist():
                if not r["qi"] or not r["ri"]:
                    continue
                qi, ri = np.array(r["qi"]), np.array(r["ri"])
                q = np.frombuffer(r["qv"], np.float32).reshape(len(qi), -1).astype(np.float64)
                v = np.frombuffer(r["rv"], np.float32).reshape(len(ri), -1).astype(np.float64)
                if q.shape[1] != v.shape[1]:
                    continue
                score = np.round((q @ v.T) / np.outer(np.linalg.norm(q, axis=1), np.linalg.norm(v, axis=1)), DIGITS)
                if every_tie:
                    a, c = np.nonzero(score >= (np.partition(score, score.shape[1] - k, axis=1)[:, score.shape[1] - k] if score.shape[1] > k else np.full(len(qi), -np.inf))[:, None])
                    yield pa.RecordBatch.from_arrays([pa.array(qi[a]), pa.array(ri[c]), pa.array(score[a, c])], names=["query_id", ident, "score"])
                    continue
                score[qi[:, None] == ri[None, :]] = -np.inf
                order = np.lexsort((np.broadcast_to(ri, score.shape), -score), axis=1)[:, :k]
                kept = np.take_along_axis(score, order, 1)
                flat = np.isfinite(kept)
                yield pa.RecordBatch.from_arrays([pa.array(np.repeat(qi, flat.sum(1))), pa.array(ri[order][flat]), pa.array(kept[flat])], names=["query_id", ident, "score"])

    pairs = packed(queries, ("qi", "qv")).crossJoin(packed(rows, ("ri", "rv")))  # blocks of a stated query set against blocks of all rows
    scored = pairs.mapInArrow(compare, f"query_id {kind}, {ident} {kind}, score double")
    return scored if every_tie else top_k(scored, k, "query_id", ident)


def cosine_top_k_shared(queries: DataFrame, rows: DataFrame, vectors: DataFrame, k: int) -> DataFrame:
    """(query_id, id, score, rank): :func:`cosine_top_k` for rows (id, vec_id) that share the vectors (vec_id, embedding).

    Vectors are compared once, whatever number of rows has them. A vector is expanded to its first k + 1 rows only if
    the vectors that score higher have no k + 1 rows; a query's own row is then left out. ``queries``: (id, vec_id).
    """
    place = F.row_number().over(Window.partitionBy("vec_id").orderBy("id"))
    first = rows.withColumn("place", place).where(F.col("place") <= k + 1).drop("place")
    many = first.groupBy("vec_id").agg(F.count("*").alias("n"))
    used = vectors.join(many, "vec_id", "left_semi")
    asked = vectors.join(queries.select("vec_id").distinct(), "vec_id", "left_semi")
    near = cosine_top_k(asked, used, "vec_id", "embedding", k + 1, every_tie=True).join(many, "vec_id")
    by_query = Window.partitionBy("query_id")
    before = F.sum("n").over(by_query.orderBy(F.desc("score"))) - F.sum("n").over(Window.partitionBy("query_id", "score"))
    near = near.repartition("query_id").withColumn("before", before).where(F.col("before") <= k).select(F.col("query_id").alias("of"), "vec_id", "score")
    best = top_k(near.join(first, "vec_id"), k + 1, "of", "id").select(F.col("of").alias("vec_id"), "id", "score")
    each = queries.select(F.col("id").alias("query_id"), "vec_id").join(best, "vec_id").where("query_id <> id").select("query_id", "id", "score")
    return top_k(each, k, "query_id", "id")


def fuse(rankings: list[tuple[DataFrame, float]], k: int = RRF_K) -> DataFrame:
    """(query_id, doc_id, score): weighted reciprocal rank fusion of (query_id, doc_id, rank) rankings."""
    weights = [w for _, w in rankings]
    if not weights or any(not np.isfinite(w) or w < 0 for w in weights) or not any(weights):
        raise ValueError("weights must be finite, not negative and not all zero")
    out = None
    for ranking, w in rankings:
        one = ranking.select("query_id", "doc_id", (F.lit(float(w)) / (k + F.col("rank"))).alias("part"))
        out = one if out is None else out.unionByName(one)
    return out.repartition("query_id").groupBy("query_id", "doc_id").agg(F.round(F.sum("part"), 9).alias("score"))  # one shuffle for the sums and for ranks by query


def fused(fields: list[dict], stage: str, weights: tuple[float, ...], k: int) -> tuple[list, np.ndarray]:
    """The k best ids and scores of :func:`fuse` over the lists of one stage and query; equal scores by id."""
    parts: dict = {}
    for own, w in zip(fields, weights, strict=True):
        for rank, ident in enumerate(own[stage][0], 1):
            parts[ident] = parts.get(ident, 0.0) + w / (RRF_K + rank)
    return _in_order(list(parts), np.round(np.fromiter(parts.values(), float, len(parts)), 9), k)


# ------------------------------------------------------------------ candidate pools (per query, at most 100 rows each)


class Pool:
    """An ordered choice of at most ``size`` distinct ids, each with the source it came from."""

    def __init__(self, size: int = POOL):
        self.size, self.source = size, {}

    def take(self, ident, source: str) -> bool:
        if len(self.source) >= self.size or ident in self.source:
            return False
        self.source[ident] = source
        return True

    def fill(self, ranking: list, source: str, quota: int | None = None) -> None:
        """Takes from the top until the pool is full or ``quota`` new ids were taken."""
        taken = 0
        for ident in ranking:
            if quota is not None and taken >= quota:
                break
            taken += self.take(ident, source)

    def alternate(self, rankings: list[list], source: str, counts: list[int], quota: int) -> None:
        """Takes one new id of each ranking in turn; ``counts`` remembers how many each has given."""
        going = True
        while going and len(self.source) < self.size:
            going = False
            for i, ranking in enumerate(rankings):
                if counts[i] < quota:
                    fresh = next((x for x in ranking if x not in self.source), None)
                    if fresh is not None and self.take(fresh, source):
                        counts[i] += 1
                        going = True


def facet_pool(main: list, facets: list[list]) -> list[tuple]:
    """(id, source): the main ranking's head, then facets in turn up to a quota each, the main rest, the facets' rest."""
    pool, counts = Pool(), [0] * len(facets)
    pool.fill(main[:RESERVED], "main")
    pool.alternate(facets, "facet", counts, FACET_QUOTA)
    pool.fill(main[RESERVED:], "main_rest")
    pool.alternate(facets, "facet_rest", counts, POOL)
    return list(pool.source.items())


def preferred_pool(main: list, preferred: list, facets: list[list]) -> list[tuple]:
    """(id, source): a reserved head, up to 30 new preferred ids, facets in turn, then whatever is left of both."""
    pool = Pool()
    pool.fill(main[: RESERVED_WITH_FACETS if facets else RESERVED], "broad_reserved")
    pool.fill(preferred, "preferred", PREFERRED)
    pool.alternate(facets, "facet", [0] * len(facets), POOL)
    pool.fill(main, "broad_fill")
    pool.fill(preferred, "preferred_fill")
    return list(pool.source.items())


def graded_selection(rows: DataFrame, facets: list[str], top: int, lead: int = 5, within: int = 10) -> DataFrame:
    """(query_id, doc_id, rank): the ``top`` best of each query by grade, then by place; null grades and places are lowest.

    ``rows``: query_id, doc_id, grade, place and one column of ranks for each facet. The first ``lead`` are the best
    graded. Then each facet, in turn, that none of the chosen meets (a rank of at most ``within``) adds its best row,
    while there is room; the rest follows in the order of grades.
    """
    query = Window.partitionBy("query_id")
    best = query.orderBy(F.coalesce("grade", F.lit(0)).desc(), F.coalesce("place", F.lit(0)), "doc_id")
    out = rows.withColumn("plain", F.row_number().over(best)).withColumn("turn", F.when(F.col("plain") <= min(lead, top), F.col("plain")))
    for facet in facets:
        meets = F.coalesce(F.col(facet) <= within, F.lit(False))
        taken, met = F.count("turn").over(query), F.max(F.col("turn").isNotNull() & meets).over(query)
        first = F.row_number().over(query.orderBy((F.col("turn").isNull() & meets).desc(), F.col(facet).asc_nulls_last(), "plain"))
        adds = (first == 1) & F.col("turn").isNull() & meets & ~met & (taken < top)
        out = out.withColumn("next", F.when(adds, taken + 1)).withColumn("turn", F.coalesce("turn", "next")).drop("next")
    place = F.row_number().over(query.orderBy(F.col("turn").asc_nulls_last(), "plain")).cast("long")
    return out.withColumn("rank", place).where(F.col("rank") <= top).select("query_id", "doc_id", "rank")


def pooled(rankings: DataFrame, pool, names: list[str]) -> DataFrame:
    """Applies a pool function to each query's rankings: ``rankings`` has (query_id, stage, doc_id, rank), at most 100 ranks a stage.

    Returns (query_id, doc_id, place, source). ``names`` lists the stages in the order of the function's arguments,
    stages of facets last.
    """
    import pandas as pd

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        by = {s: list(g.sort_values("rank")["doc_id"]) for s, g in pdf.groupby("stage")}
        plain = [by.get(n, []) for n in names]
        facets = [by[s] for s in sorted(by) if s.startswith("facet")]
        got = pool(*plain, facets)
        return pd.DataFrame({"query_id": pdf["query_id"].iloc[0], "doc_id": [g[0] for g in got], "place": range(1, len(got) + 1), "source": [g[1] for g in got]})

    kinds = dict(rankings.dtypes)
    return rankings.groupBy("query_id").applyInPandas(run, f"query_id {kinds['query_id']}, doc_id {kinds['doc_id']}, place long, source string")


def grade(object_scope: Column, focus_scope: Column) -> Column:
    """Relevance 0 to 3 of a judged pair of scopes."""
    none = object_scope.isin("NONE", "UNKNOWN") | focus_scope.isin("NONE", "UNKNOWN")
    same = object_scope.isin("SAME", "INSTANCE")
    two = (same & focus_scope.isin("CORE", "TRACE")) | ((object_scope == "FLOW") & (focus_scope == "TRACE"))
    return F.when(none, 0).when(same & (focus_scope == "SAME"), 3).when(two, 2).otherwise(1)


def accepted(judged: DataFrame) -> DataFrame:
    """Keeps pairs of grade 2 or more whose two quotes are written in the text; blank quotes ground nothing."""
    grounded = lambda q: (F.trim(q) != "") & F.col("text").contains(F.col(q))
    return judged.where((F.col("grade") >= 2) & F.coalesce(grounded("object_quote") & grounded("focus_quote"), F.lit(False)))
