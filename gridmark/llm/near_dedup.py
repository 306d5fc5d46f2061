"""MinHash near-dedup: multi-index Hamming join over b-bit signatures, links confirmed on full shingle sets.

Words are runs of other than white space after lower-casing A-Z; a document's set has its distinct 5-word
shingles (fewer words: the sequence as one; none: the empty set, linked with nothing). Documents are linked
when 100 * intersection >= 85 * union.

1. Sign: 60 minhash slots of 16 bits, and a 128-bit digest of the whole set. Equal sets form a class; one
   representative (the least id) of each goes on.
2. Index: slots are split into 10 chunks of 6. Two signatures that differ in at most 19 slots have, by
   pigeonhole, a chunk with at most one differing slot; each chunk is indexed with every one of its slots
   left out (the allowed errors enumerated). So every pair within distance 19 meets under a key, and most
   pairs beyond. A pair at the link threshold meets none with probability 3e-7, and more than 24 slots (where
   pairs are dropped) differ with probability 2e-6.
3. Confirm: within a key no all-pairs list is made. Rounds link members to a centre of their key. Pairs inside one
   component can't change the components, so none that matters is left out. Neither do pairs whose sizes, shingles
   that no other member has, or intersections with the centre (all counted exactly) bound their intersection too low
   to link; a member that shares too few shingles with all others to link with any leaves its key. The pairs still
   open are listed when the bounds leave no more of them than the index has rows, by the rate at which they left
   pairs of the last centres. As long as there are more, a round takes as many centres of each key as make about that
   many, and these centres, now met with all of their key, leave it. So what a round lists grows with the input,
   however many members a key has; the bounds themselves are looked at for every open pair, inside the join.
   Pairs farther apart than 24 slots are dropped (with ``exact`` none is), the others are decided on the full sets.
4. Components by least label; every document gets that of its class.

Hot keys: all joins are between written tables, so adaptive execution can split a key's rows.
Defined results. Null or empty text: an empty set. Null id: takes no part in choosing representatives; it has
the component of its equals (null if none has an id) and is not kept. Repeated rows: each is returned.
Rows that share an id but not a text: each has its own links; a component is named by its least id, and in it a row
of that id is kept. Empty table: no rows. Other columns are ignored.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from itertools import combinations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from gridmark.llm.common import Scratch, prepare, row_key, row_slices, tidy, without
from gridmark.llm.components import connected_components
from gridmark.llm.hashing import joined, mix, raw, seeded, words

SHINGLE, SLOTS, CHUNKS, ERRORS = 5, 60, 10, 1
GUARANTEED = (ERRORS + 1) * CHUNKS - 1
DISTANCE = 24
SHARE = (85, 100)
PIECE = 1_000_000
CROWD, PARTS, ENTRIES = 8, 8, 4_000_000
MEMBER = ("key", "rep", "n", "left", "m", "c", "comp")
FEW_FILES, PER_FILE = 12, 20_000  # documents for each file of a written table, from so many files on
_FACTORS = seeded(SLOTS, 11) | np.uint64(1)


def shingle_sets(texts: pa.Array, n: int = SHINGLE) -> list[np.ndarray]:
    """The sorted hashes of each text's set."""
    found = words(*raw(texts))
    grams, sets = joined(found.hashes, n), []
    for a, b in zip(found.first[:-1].tolist(), found.first[1:].tolist(), strict=True):
        if b - a >= n:
            sets.append(np.unique(grams[a : b - n + 1]))
        elif b > a:
            sets.append(joined(found.hashes[a:b], b - a))
        else:
            sets.append(np.zeros(0, np.uint64))
    return sets


def signatures(sets: list[np.ndarray]) -> np.ndarray:
    """SLOTS values of 16 bits for each set that isn't empty."""
    flat = np.concatenate(sets)
    at = np.cumsum([0, *(len(x) for x in sets[:-1])])
    out = np.empty((len(sets), SLOTS), np.uint16)
    with np.errstate(over="ignore"):
        for k, factor in enumerate(_FACTORS):
            out[:, k] = (mix(np.minimum.reduceat(flat * factor, at)) >> np.uint64(48)).astype(np.uint16)
    return out


def _sign(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for rows, texts in row_slices(batch, "text", PIECE):
            sets = shingle_sets(texts)
            full = [s for s in sets if len(s)]
            signed = iter(signatures(full)) if full else iter(())
            yield pa.record_batch(
                {
                    "doc_id": rows.column("doc_id"),
                    "key": rows.column("key"),
                    "n_shingles": pa.array([len(s) for s in sets], pa.int64()),
                    "digest": pa.array([hashlib.blake2b(s.tobytes(), digest_size=16).digest() if len(s) else None for s in sets], pa.binary()),
                    "sig": pa.array([next(signed).tobytes() if len(s) else None for s in sets], pa.binary()),
                }
            )


def _keys(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Each signature under each key: a chunk with ERRORS of its slots left out, and what these hold.

    Signatures with a whole chunk in common meet under all of its keys; the first, where left is -1, is enough for them.
    """
    width = SLOTS // CHUNKS
    for batch in batches:
        n = batch.num_rows
        sig = np.frombuffer(b"".join(batch.column("sig").to_pylist()), np.uint16).reshape(n, CHUNKS, width).astype(np.uint64)
        made, left = [], []
        with np.errstate(over="ignore"):
            for chunk in range(CHUNKS):
                for number, kept in enumerate(combinations(range(width), width - ERRORS)):
                    value = np.full(n, chunk * 64 + number + 1, np.uint64)
                    for slot in kept:
                        value = mix(value + sig[:, chunk, slot])
                    made.append(value)
                    out = [slot for slot in range(width) if slot not in kept]
                    left.append(sum(sig[:, chunk, slot].astype(np.int64) << (16 * k) for k, slot in enumerate(out)) if number else np.full(n, -1))
        keys = np.stack(made, 1).reshape(-1).view(np.int64) if made else np.zeros(0, np.int64)
        reps, sizes = (np.repeat(batch.column(c).to_numpy(zero_copy_only=False), len(made)) for c in ("rep", "n"))
        yield pa.record_batch({"key": pa.array(keys), "rep": pa.array(reps, pa.int64()), "n": pa.array(sizes, pa.int64()), "left": pa.array(np.stack(left, 1).reshape(-1), pa.int64())})


def _near(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Pairs whose signatures differ in at most DISTANCE slots."""
    for batch in batches:
        a, b = (np.frombuffer(b"".join(batch.column(c).to_pylist()), np.uint16).reshape(-1, SLOTS) for c in ("sa", "sb"))
        yield batch.select(["a", "b"]).filter(pa.array((a != b).sum(1) <= DISTANCE))


def _confirm(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        at = 0
        while at < batch.num_rows:
            part = batch.slice(at, 256)
            at += 256
            a, b = (shingle_sets(part.column(c).cast(pa.large_string()).fill_null("")) for c in ("ta", "tb"))
            common = np.array([len(np.intersect1d(x, y, assume_unique=True)) for x, y in zip(a, b, strict=True)], np.int64)
            sizes = np.array([len(x) + len(y) for x, y in zip(a, b, strict=True)], np.int64)
            linked = SHARE[1] * common >= SHARE[0] * (sizes - common)
            yield pa.record_batch({"a": part.column("a"), "b": part.column("b"), "common": pa.array(common), "linked": pa.array(linked)})


def near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", rounds: int = 2, exact: bool = False, budget: int | None = None) -> DataFrame:
    """A row per row of docs: doc_id, n_shingles, component_id, kept.

    rounds: how many rounds of single centres there are at most, two at least. budget: about how many pairs are listed at once, by
    default as many as the index has rows. Both change the work, not the result. exact: pairs that meet in the index are decided on
    the full sets however far apart their signatures are.
    """
    return _judged(docs, id_col, text_col, rounds, exact, budget).select("doc_id", "n_shingles", "component_id", "kept")


def _judged(docs: DataFrame, id_col: str, text_col: str, rounds: int = 2, exact: bool = False, budget: int | None = None) -> DataFrame:
    """near_duplicates with key (row_key of the text) and first: whether the row's set is the one that its component keeps."""
    spark = prepare(docs.sparkSession)
    scratch = Scratch(spark, "near-dedup")
    texts = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    signed = scratch.put(texts.withColumn("key", row_key(F.col("text"))).mapInArrow(tidy(_sign), "doc_id long, key binary, n_shingles long, digest binary, sig binary"), "signed")
    classes = signed.filter("digest IS NOT NULL AND doc_id IS NOT NULL").groupBy("digest").agg(F.min("doc_id").alias("least"), F.first("sig").alias("sig"), F.first("n_shingles").alias("n"))
    files = max(FEW_FILES, signed.count() // PER_FILE)
    reps = scratch.put(_named(scratch.put(classes, "classes", files), signed), "reps", files)
    index = scratch.put(reps.select("rep", "n", "sig").mapInArrow(tidy(_keys), "key long, rep long, n long, left long"), "index", files)
    shared = scratch.put(index.groupBy("key").agg(F.min("rep").alias("low"), F.max("rep").alias("high")).filter("low < high").select(F.col("key").alias("k")), "shared", files)
    members = scratch.put(index.join(shared, F.col("key") == F.col("k"), "left_semi"), "members", files)
    scratch.drop("classes", "index", "shared")

    # Texts of the members only; each is read again by the rounds.
    named = reps.join(members.select(F.col("rep").alias("r")).distinct(), F.col("rep") == F.col("r"), "left_semi").select(F.col("least").alias("doc"), F.col("digest").alias("d"), F.col("rep").alias("node"))
    held = texts.select("doc_id", "text", row_key(F.col("text")).alias("key"))
    whose = signed.select(F.col("doc_id").alias("sid"), F.col("key").alias("skey"), "digest").join(named, (F.col("sid") == F.col("doc")) & (F.col("digest") == F.col("d"))).groupBy("node", "sid").agg(F.min("skey").alias("skey"))
    held = scratch.put(held.join(whose, (F.col("doc_id") == F.col("sid")) & (F.col("key") == F.col("skey"))).select(F.col("node").alias("doc_id"), "text"), "held")
    if held.count() > held.select("doc_id").distinct().count():  # rows that repeat id and text
        held = scratch.put(held.groupBy("doc_id").agg(F.first("text").alias("text")), "held-once")

    none = F.lit(None).cast("long")
    at = scratch.put(members.select("key", "rep", "n", "left", none.alias("m"), none.alias("c"), F.col("rep").alias("comp")).select(*MEMBER), "at-0", files)
    scratch.drop("members")
    size, turn, links, tested, met, idle = at.count() if budget is None else budget, 0, None, None, None, False
    reach = size  # how many open pairs leave about size of them to list
    while True:
        pairs_open, squares = _open_pairs(at)
        last = turn > 0 and pairs_open <= reach
        many = not last and turn > 1 and (turn >= rounds or idle)  # after the first two, which give the bounds
        different, key = F.col("comp") != F.col("comp2"), F.col("key") == F.col("key2")
        if last:
            # A whole chunk in common is met under its first key.
            other, wanted = at, (F.col("comp") < F.col("comp2")) & ((F.col("left") == -1) | (F.col("left") != F.col("left2"))) & _possible()
        elif many:
            other, wanted = scratch.put(_some(at, turn, reach, squares), f"centres-{turn}", files), different & _possible()
        else:
            # Centres: the least id, then in crowded keys the member with most shingles that others have; then any, by hash.
            drawn = F.xxhash64("rep", F.lit(turn))
            order = F.struct((F.col("rep") if turn == 0 else F.coalesce(-F.col("m"), drawn) if turn == 1 else drawn).alias("o"), *MEMBER[1:])
            other = scratch.put(at.groupBy("key").agg(F.min(order).alias("x")).select("key", *[f"x.{k}" for k in MEMBER[1:]]), f"centres-{turn}", files)
            wanted = different & _possible()
            if turn == 1:
                wanted = wanted | F.col("m").isNotNull() & (F.col("rep") != F.col("rep2"))
        pairs = at.join(other.select(*[F.col(k).alias(f"{k}2") for k in MEMBER]), key & wanted)
        pairs = pairs.select(F.least("rep", "rep2").alias("a"), F.greatest("rep", "rep2").alias("b")).distinct()
        if tested is not None:
            pairs = pairs.join(tested.select("a", "b"), ["a", "b"], "left_anti")
        pairs = scratch.put(pairs, f"pairs-{turn}", files)
        found = scratch.put(_counted(pairs, reps, held, near_only=turn > 1 and not exact), f"found-{turn}", files)
        listed = pairs.count()
        idle = 50 * found.filter("linked").count() < listed
        if many:
            reach = max(size, reach * size // max(1, listed))
        tested = pairs if tested is None else tested.unionByName(pairs)
        met = found if met is None else met.unionByName(found)
        links = met.filter("linked")
        labelled = connected_components(links, scratch, f"labels-{turn}", files)
        if last:
            break
        if many:  # centres have met all of their key
            at = at.join(other.select(F.col("key").alias("ck"), F.col("rep").alias("cr")), (F.col("key") == F.col("ck")) & (F.col("rep") == F.col("cr")), "left_anti")
        at = at.join(labelled, F.col("rep") == F.col("node"), "left").select("key", "rep", "n", "left", "m", "c", F.coalesce("label", "rep").alias("comp"))
        at = scratch.put(at, f"labelled-{turn}", files)
        at = _open(at)
        if turn < 2:
            at = scratch.put(at, f"open-{turn}", files)
            name = "m" if turn == 0 else "c"
            known = scratch.put(_commons(at, held) if turn == 0 else _with_centre(at, other, met), name, files)
            at = at.drop(name).join(known, (F.col("key") == F.col("bk")) & (F.col("rep") == F.col("br")), "left").select(*MEMBER)
            at = at.filter(F.col("m").isNull() | (SHARE[1] * F.col("m") >= SHARE[0] * F.col("n")))  # the others can't link here
        turn += 1
        at = scratch.put(at, f"at-{turn}", files)
        scratch.drop(f"at-{turn - 1}", f"labelled-{turn - 1}", f"open-{turn - 1}", f"centres-{turn - 1}", f"labels-{turn - 1}", "m", "c")

    # A component is named by its least id; of the sets with that id the one with the least digest is its first.
    labels = reps.join(labelled, F.col("rep") == F.col("node"), "left").select("digest", "least", F.coalesce("label", "rep").alias("label"))
    firsts = labels.groupBy("label").agg(F.min(F.struct("least", "digest")).alias("f")).select(F.col("label").alias("fl"), "f")
    final = scratch.put(labels.join(firsts, F.col("label") == F.col("fl")).select(F.col("digest").alias("set"), F.col("f.least").alias("name"), (F.col("digest") == F.col("f.digest")).alias("leads")), "final", files)
    out = signed.select("doc_id", "key", "n_shingles", "digest").join(final, F.col("digest") == F.col("set"), "left")
    component, named = F.coalesce("name", "doc_id"), F.coalesce(F.col("doc_id") == F.coalesce("name", "doc_id"), F.lit(False))
    return out.select("doc_id", "key", "n_shingles", component.alias("component_id"), named.alias("kept"), (named & F.coalesce("leads", F.lit(True))).alias("first"))


def _named(classes: DataFrame, signed: DataFrame) -> DataFrame:
    """classes with rep, a number for each that no other has: its least id, or one that is no id where classes share that."""
    shared = classes.groupBy("least").agg(F.min("digest").alias("d"), F.count(F.lit(1)).alias("c")).filter("c > 1").select(F.col("least").alias("l"), "d")
    if shared.isEmpty():
        return classes.withColumn("rep", F.col("least"))
    low, high = signed.agg(F.min("doc_id"), F.max("doc_id")).first()
    number = F.monotonically_increasing_id()  # of a written table: the same whenever it is computed
    free = number + F.lit(high + 1) if high < 1 << 62 else F.lit(low - 1) - number
    other = F.col("l").isNotNull() & (F.col("digest") != F.col("d"))
    return classes.join(shared, F.col("least") == F.col("l"), "left").withColumn("rep", F.when(other, free).otherwise(F.col("least"))).drop("l", "d")


def _open(at: DataFrame) -> DataFrame:
    """Members of keys that hold more than one component; no pair of another key can change the components."""
    mixed = at.groupBy("key").agg(F.min("comp").alias("low"), F.max("comp").alias("high")).filter("low < high").select(F.col("key").alias("k"))
    return at.join(mixed, F.col("key") == F.col("k"), "left_semi")


def _some(at: DataFrame, turn: int, size: int, squares: float) -> DataFrame:
    """Members drawn by hash, of each key so many that they and its members make about ``size`` pairs in all keys."""
    each = at.groupBy("key").agg(F.count(F.lit(1)).alias("all"), F.min("comp").alias("low"), F.max("comp").alias("high")).filter("low < high").select(F.col("key").alias("k"), "all")
    share = F.greatest(F.lit(1.0) / F.col("all"), F.lit(size / max(1.0, squares)))
    drawn = F.pmod(F.xxhash64("rep", F.lit(turn), "key"), F.lit(1 << 30)) < share * (1 << 30)
    return at.join(each, F.col("key") == F.col("k")).filter(drawn).select(*MEMBER)


def _deal(parts: int, batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Shingles of each batch of texts with the ids that have them, by ranges of hashes."""
    shift = np.uint64(64 - (parts.bit_length() - 1))
    for batch in batches:
        for rows, texts in row_slices(batch, "text", PIECE):
            sets = shingle_sets(texts)
            owner = np.repeat(rows.column("doc_id").to_numpy(zero_copy_only=False), [len(x) for x in sets])
            hashes = np.concatenate(sets)
            order = np.argsort(hashes)
            hashes, owner = hashes[order], owner[order]
            cuts = [0, *np.searchsorted(hashes, np.arange(1, parts, dtype=np.uint64) << shift).tolist(), len(hashes)]
            ranges = list(zip(cuts[:-1], cuts[1:], strict=True))
            yield pa.record_batch({"part": pa.array(range(parts), pa.int32()), "hashes": pa.array([hashes[a:b].tobytes() for a, b in ranges], pa.binary()), "owners": pa.array([owner[a:b].tobytes() for a, b in ranges], pa.binary())})


def _alone(table: pa.Table) -> pa.Table:
    """How many shingles of a range each id has for itself."""
    hashes, owner = (np.frombuffer(b"".join(table.column(c).to_pylist()), kind) for c, kind in (("hashes", np.uint64), ("owners", np.int64)))
    order = np.argsort(hashes, kind="stable")
    ordered = hashes[order]
    edge = np.concatenate([[True], ordered[1:] != ordered[:-1], [True]])
    ids, n = np.unique(owner[order][edge[:-1] & edge[1:]], return_counts=True)
    return pa.table({"rep": pa.array(ids, pa.int64()), "own": pa.array(n, pa.int64())})


def _commons(at: DataFrame, held: DataFrame) -> DataFrame:
    """bk, br, m for members of crowded keys that have open pairs: how many of its shingles some other such member has too."""
    crowded = at.groupBy("key").agg(F.count(F.lit(1)).alias("all"), F.min("comp").alias("low"), F.max("comp").alias("high")).filter((F.col("all") >= CROWD) & (F.col("low") < F.col("high"))).select(F.col("key").alias("k"))
    rows = at.join(crowded, F.col("key") == F.col("k"), "left_semi").select("key", "rep", "n")
    crowd = rows.select(F.col("rep").alias("cr"), "n").distinct()
    parts = max(PARTS, 1 << ((crowd.agg(F.sum("n")).first()[0] or 0) // ENTRIES).bit_length())
    dealt = held.join(crowd, F.col("doc_id") == F.col("cr"), "left_semi").mapInArrow(tidy(lambda b: _deal(parts, b)), "part int, hashes binary, owners binary")
    alone = dealt.groupBy("part").applyInArrow(_alone, "rep long, own long").groupBy("rep").agg(F.sum("own").alias("own")).withColumnRenamed("rep", "lr")
    rows = rows.join(alone, F.col("rep") == F.col("lr"), "left")
    return rows.select(F.col("key").alias("bk"), F.col("rep").alias("br"), (F.col("n") - F.coalesce("own", F.lit(0))).alias("m"))


def _with_centre(at: DataFrame, centres: DataFrame, met: DataFrame) -> DataFrame:
    """bk, br, c for members that have m: how many shingles the member has in common with its key's centre."""
    rows = at.filter("m IS NOT NULL").select("key", "rep", "n").join(centres.select(F.col("key").alias("ck"), F.col("rep").alias("centre")), F.col("key") == F.col("ck"))
    rows = rows.withColumn("a1", F.least("rep", "centre")).withColumn("b1", F.greatest("rep", "centre"))
    rows = rows.join(met.select("a", "b", "common"), (F.col("a1") == F.col("a")) & (F.col("b1") == F.col("b")), "left")
    return rows.select(F.col("key").alias("bk"), F.col("rep").alias("br"), F.when(F.col("rep") == F.col("centre"), F.col("n")).otherwise(F.col("common")).alias("c"))


def _possible():
    """Whether the sizes of two members leave room for a link: 100 * i >= 85 * (n + n2 - i), that is 185 * i >= 85 * (n + n2).

    The intersection i is at most n of either. In a crowded key it is at most m of either, and at most what both
    have of the centre's shingles plus what both have besides and share with anyone (m - c of either).
    """
    by_size = F.least("n", "n2")
    by_crowd = F.least("m", "m2")
    by_centre = F.least("c", "c2") + F.least(F.col("m") - F.col("c"), F.col("m2") - F.col("c2"))
    known = F.col("c").isNotNull() & F.col("c2").isNotNull()
    most = F.when(known, F.least(by_crowd, by_centre)).when(F.col("m").isNotNull() & F.col("m2").isNotNull(), by_crowd).otherwise(by_size)
    return (SHARE[0] + SHARE[1]) * most >= SHARE[0] * (F.col("n") + F.col("n2"))


def _open_pairs(at: DataFrame) -> tuple[float, float]:
    """Pairs under a key that are in different components, and squares of the members of all keys that have such."""
    each = at.groupBy("key", "comp").agg(F.count(F.lit(1)).cast("double").alias("n"))
    of_key = each.groupBy("key").agg(F.sum("n").alias("all"), F.sum(F.col("n") * F.col("n")).alias("same"))
    squared = F.col("all") * F.col("all")
    found = of_key.agg(F.sum((squared - F.col("same")) / 2), F.sum(F.when(squared > F.col("same"), squared))).first()
    return found[0] or 0.0, found[1] or 0.0


def _counted(pairs: DataFrame, reps: DataFrame, held: DataFrame, near_only: bool) -> DataFrame:
    """a, b, common (shingles), linked for each pair; near_only: for those whose signatures are near."""
    if near_only:
        sig = lambda n: reps.select(F.col("rep").alias(f"r{n}"), F.col("sig").alias(f"s{n}"))
        pairs = pairs.join(sig("a"), F.col("a") == F.col("ra")).join(sig("b"), F.col("b") == F.col("rb")).select("a", "b", "sa", "sb").mapInArrow(tidy(_near), "a long, b long")
    text = lambda n: held.select(F.col("doc_id").alias(f"d{n}"), F.col("text").alias(f"t{n}"))
    both = pairs.join(text("a"), F.col("a") == F.col("da")).join(text("b"), F.col("b") == F.col("db")).select("a", "b", "ta", "tb")
    return both.mapInArrow(tidy(_confirm), "a long, b long, common long, linked boolean")


def keep_firsts(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """docs with one document of each group, the one with the least id; all columns as they were, whatever their names.

    Rows, not ids, go: a row is known by its id and its text. Of rows that share the least id of a group but not the text,
    those with one set of shingles stay. Rows without an id or without words stay.
    """
    judged = _judged(docs, id_col, text_col).filter("NOT first AND doc_id IS NOT NULL")
    return without(docs, judged.select(F.col("doc_id").alias("id"), "key"), id_col, text_col)
