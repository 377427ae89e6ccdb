"""Language-model scoring by a hierarchical Pitman-Yor model.

Restaurants: one for each word before a word (and for the text end, which is also the context of a first word), all sharing one parent, whose base is
uniform over the known words and one unknown. Every context word of the training texts has a restaurant, however rare.

Seats are sampled by Gibbs sweeps, each of these in turn. Of each restaurant with T tables a gamma variable z of shape strength / discount + T is drawn; given these, and given the parent's
distribution p, the dishes of all restaurants are independent: a dish with c customers has t tables with a probability in proportion to S(c, t) (discount z p)^t (`_seating`), so all customers of a
dish are seated anew in one exact draw, and blocks of dishes need not wait for each other. The parent's dishes are drawn alike with the new tables as customers, and p from its Dirichlet
posterior. Nothing but the chance that the parent's unseated share falls on a known word is replaced by its mean. Gamma variables are functions of a word, its counts and the sweep, so blocks that
share a word or a context agree on them. The state of each sweep is written to the shared folder and read by the next one. Probabilities are averaged over the last sweeps.

Frequent words are those with at least `SHARE` of the training tokens, so there are at most 1 / SHARE of them. Tokens are dealt by word, so a rare
word's customers in all restaurants, and its tables in the parent, are in one block; a frequent word's by its context if that is rare, else by word and context.
What blocks need of each other: totals of frequent words' restaurants and of their customers in the parent, and a few more, which go through the driver and are bounded by 1 / SHARE; and
totals of rare words' restaurants, which do not: blocks send theirs to ranges of contexts, which add them up and send them back (`totals_by_block`). Dishes of one customer always have one table,
so that only restaurants with larger dishes are sent before the sweeps that are averaged.
Discounts come from the counts of counts, the strength is fixed. Everything is over all training tokens; nothing is pruned.

Words are told apart by 64-bit hashes: among 10^8 distinct words two are the same with a chance of 3e-4.

Edge cases: a null text is an empty one, of one end token; a null id is in training; words unknown to training share one entry of the base; without training
texts all words are unknown and every score is 0. Repeated rows are documents of their own; very long texts are slices of their own. An empty table gives no rows. Only the id, the text and the
expression for held-out rows are looked at, so further columns may have any names.
"""

from __future__ import annotations

import uuid

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import _seating as S
from . import _text as X
from ._shared import settled, shared_path
from .jaccard import hash_range, packed_sorted, planes, unpacked_sorted, unplaned
from .warc import file_system

#: Share of training tokens from which on a word is frequent.
SHARE = 1e-4
SWEEPS, AVERAGED, STRENGTH, SEED = 12, 4, 0.5, 20240101
CHUNK_TOKENS, BLOCK_TOKENS, GROUP_DOCS = 700_000, 1_000_000, 20_000
END = np.uint64(0x5E3D)
_LN10 = float(np.log(10))
#: Kinds of gamma variables.
_OF_CONTEXT, _OF_WORD, _OF_PARENT, _OF_REST = range(4)
#: Gamma variables are added up in units of this, so that sums do not depend on their order.
_UNIT = 2.0**-10


def tokens(raw: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of the tokens (words, then an end, text by text) and the offsets of texts among them."""
    raw = X.lower_ascii(raw)
    starts, ends, first = X.words(raw, offsets)
    doc = np.repeat(np.arange(len(offsets) - 1), np.diff(first))
    out = np.full(len(starts) + len(offsets) - 1, END, np.uint64)
    out[np.arange(len(starts)) + doc] = X.span_hashes(raw, starts, ends)
    return out, first + np.arange(len(offsets))


class Finder:
    """The numbers of words among the frequent ones (in order); words that are not get the number after the last."""

    def __init__(self, frequent: np.ndarray):
        self.frequent, self.none = frequent, len(frequent)
        slot = (frequent >> np.uint64(44)).astype(np.int64)
        self.table = np.full(1 << 20, self.none, np.int32)
        self.table[slot] = np.arange(self.none)
        self.crowded = np.bincount(slot, minlength=1 << 20) > 1

    def find(self, words: np.ndarray) -> np.ndarray:
        slot = (words >> np.uint64(44)).astype(np.int32)
        at = self.table[slot]
        more = np.flatnonzero(self.crowded[slot])
        at[more] = np.minimum(np.searchsorted(self.frequent, words[more]), self.none - 1)
        return np.where(self.frequent[np.minimum(at, self.none - 1)] == words, at, self.none)


def _squeezed(data: bytes) -> bytes:
    return len(data).to_bytes(8, "little") + pa.compress(data, codec="zstd", asbytes=True)


def _loose(data: bytes) -> bytes:
    return pa.decompress(data[8:], int.from_bytes(data[:8], "little"), codec="zstd", asbytes=True)


def frequent_words(source: DataFrame, share: float) -> tuple[np.ndarray, int]:
    """Hashes of the words with at least `share` of the training tokens (and of the end), in order; number of training tokens."""
    spark = source.sparkSession
    ranges = max(64, int(spark.conf.get("spark.sql.shuffle.partitions")))

    def count(batches):
        held, n = [], 0

        def rows():
            key, times = _summed(held)
            cut = np.searchsorted(hash_range(key, ranges), np.arange(ranges + 1))
            some = np.flatnonzero(np.diff(cut)).tolist()
            return pa.RecordBatch.from_arrays(
                [
                    pa.array(some, pa.int32()),
                    pa.array([packed_sorted(key[cut[b] : cut[b + 1]]) for b in some], pa.binary()),
                    pa.array([planes(times[cut[b] : cut[b + 1]], 5) for b in some], pa.binary()),
                ],
                ["bucket", "words", "counts"],
            )

        for part, raw, offsets in X.slices(batches, "text"):
            token, first = tokens(raw, offsets)
            train = np.repeat(part.column("train").to_numpy(zero_copy_only=False).astype(bool), np.diff(first))
            if train.any():
                ordered = np.sort(token[train])
                at = np.flatnonzero(np.append(True, ordered[1:] != ordered[:-1]))
                held.append((ordered[at], np.diff(np.append(at, len(ordered)))))
                n += len(ordered)
            if n >= 2 * CHUNK_TOKENS:
                yield rows()
                held, n = [], 0
        if held:
            yield rows()

    def add(table: pa.Table) -> pa.Table:
        key, times = _summed([(unpacked_sorted(w), unplaned(c, 5).astype(np.int64)) for w, c in zip(table.column("words").to_pylist(), table.column("counts").to_pylist(), strict=True)])
        # Only words with that share of this range can have it of the whole.
        take = times >= share * times.sum()
        return pa.table({"word": pa.array(np.append(key[take].view(np.int64), 0)), "n": pa.array(np.append(times[take], times.sum())), "all": pa.array(np.arange(take.sum() + 1) == take.sum())})

    counts = settled(source.mapInArrow(count, "bucket int, words binary, counts binary").groupBy("bucket").applyInArrow(add, "word long, n long, all boolean"))
    total = counts.where("all").agg(F.coalesce(F.sum("n"), F.lit(0))).first()[0]
    got = [r[0] for r in counts.where(~F.col("all") & (F.col("n") >= max(1.0, share * total))).select("word").collect()]  # at most 1 / share
    return np.unique(np.array([*got, int(END)], np.int64).view(np.uint64)), total


def _summed(held: list[tuple[np.ndarray, np.ndarray]]) -> tuple[np.ndarray, np.ndarray]:
    key, times = np.concatenate([h[0] for h in held]), np.concatenate([h[1] for h in held])
    order = np.argsort(key, kind="stable")
    key, times = key[order], times[order]
    at = np.flatnonzero(np.append(True, key[1:] != key[:-1])[: len(key)])
    return key[at], np.add.reduceat(times, at) if len(at) else times


_DEALT = ["bucket", "words", "counts", "contexts", "rare", "docs", "times", "keys", "flags"]
_DEALT_SCHEMA = "bucket int, " + ", ".join(f"{c} binary" for c in _DEALT[1:])


def dealt(source: DataFrame, frequent: np.ndarray, blocks: int, groups: int) -> DataFrame:
    """Tokens with their contexts (numbers of frequent words, then of the block's rare ones), dealt into blocks by word; documents' ids and sizes into groups (buckets from -1 down)."""
    rare, finder = len(frequent), Finder(frequent)

    def blobs(parts):
        word, doc, key, train = (np.concatenate(x) for x in zip(*parts, strict=True))
        # A text's first word follows the end of the text before it.
        before, at = np.append(END, word[:-1]), finder.find(word)
        context = np.append(finder.find(np.array([END])), at[:-1])
        often = at < rare
        place = hash_range(word, blocks)
        place[often] = hash_range(X.mix(word[often] ^ X.mix(context[often].astype(np.uint64))), blocks)
        place[often & (context == rare)] = hash_range(before[often & (context == rare)], blocks)
        times = np.ones(len(word), np.int64)
        # A frequent word after a frequent one: once a document.
        both = np.flatnonzero(often & (context < rare))
        triple = (doc[both] * rare + context[both]) * rare + at[both]
        order = np.argsort(triple, kind="stable")
        start = np.flatnonzero(np.append(True, triple[order][1:] != triple[order][:-1])[: len(triple)])
        keep = np.ones(len(word), bool)
        keep[both] = False
        lead = both[order[start]]
        keep[lead] = True
        times[lead] = np.diff(np.append(start, len(triple)))
        order = np.flatnonzero(keep)
        order = order[np.argsort(word[order], kind="stable")]
        order = order[np.argsort(place[order].astype(np.uint16 if blocks <= 1 << 16 else np.int64), kind="stable")]
        word, context, before, doc, place, times = word[order], context[order], before[order], doc[order], place[order], times[order]
        start, rows = np.flatnonzero(np.append(True, place[1:] != place[:-1])), []
        for x, y in zip(start.tolist(), [*start[1:].tolist(), len(place)], strict=True):
            first = np.flatnonzero(np.append(True, word[x:y][1:] != word[x:y][:-1]))
            there = np.zeros(len(key), bool)
            there[doc[x:y]] = True
            held = np.flatnonzero(there)
            local = (np.cumsum(there) - 1)[doc[x:y]]
            here = context[x:y]
            loose = here == rare
            own, number = np.unique(before[x:y][loose], return_inverse=True)
            here[loose] = rare + number
            rows.append((int(place[x]), packed_sorted(word[x:y][first]), planes(np.diff(np.append(first, y - x)), 4), planes(here, 4), packed_sorted(own), planes(local, 4), planes(times[x:y], 4), planes(key[held], 8), train[held].tobytes()))
        return _batch(rows)

    def _batch(rows):
        columns = list(zip(*rows, strict=True)) if rows else [[]] * 9
        return pa.RecordBatch.from_arrays([pa.array(list(x), t) for x, t in zip(columns, [pa.int32(), *[pa.binary()] * 8], strict=True)], _DEALT)

    def run(batches):
        parts, n, docs = [], 0, 0
        for part, raw, offsets in X.slices(batches, "text"):
            token, first = tokens(raw, offsets)
            size = np.diff(first)
            train = part.column("train").to_numpy(zero_copy_only=False).astype(bool)
            key = part.column("key").to_numpy()
            ident = part.column("id")
            known = np.array(ident.is_valid())
            group = (X.mix(key.view(np.uint64)) % np.uint64(groups)).astype(np.int64)
            rows = []
            for g in np.unique(group).tolist():
                m = group == g
                ids = ident.fill_null(0).to_numpy()[m]
                rows.append((-1 - g, planes(ids.view(np.uint64), 8), planes(size[m], 5), None, None, None, None, planes(key[m].view(np.uint64), 8), (train[m] + 2 * known[m]).astype(np.uint8).tobytes()))
            yield _batch(rows)
            parts.append((token, np.repeat(np.arange(docs, docs + len(size)), size), key.view(np.uint64), train))
            n, docs = n + len(token), docs + len(size)
            if n >= CHUNK_TOKENS:
                yield blobs(parts)
                parts, n, docs = [], 0, 0
        if parts:
            yield blobs(parts)

    return source.mapInArrow(run, _DEALT_SCHEMA)


#: All dishes, those of several customers (with contexts numbered: frequent ones, then `active` ones), dishes of one customer by word; documents' entries; groups of documents.
_DISHES = ["words", "dishes", "contexts", "customers", "rare"]
_SEVERAL = ["words", "several_words", "several_contexts", "several_customers", "active", "ones"]
_STORED = [*_DISHES, *_SEVERAL[1:], "entries", "docs", "times", "keys", "ids", "sizes", "flags"]
_STORED_SCHEMA = "bucket int, " + ", ".join(f"{c} binary" for c in _STORED)


def assembled(rows: DataFrame, rare: int) -> DataFrame:
    """One row a block: its dishes in order of word and context, and the documents' entries of each dish; one row a group of documents."""

    def run(table: pa.Table) -> pa.Table:
        X.release()
        bucket = table.column("bucket")[0].as_py()
        col = {c: table.column(c).to_pylist() for c in _DEALT[1:]}
        if bucket < 0:
            out = {"ids": _joined(col["words"], 8), "sizes": _joined(col["counts"], 5), "keys": _joined(col["keys"], 8), "flags": b"".join(col["flags"])}
        else:
            places, docs, times, keys, flags, base = [], [], [], [], [], 0
            of_words, own = [unpacked_sorted(x) for x in col["words"]], [unpacked_sorted(x) for x in col["rare"]]
            words, loose = np.unique(np.concatenate(of_words)), np.unique(np.concatenate(own))
            contexts = rare + len(loose)
            for i in range(table.num_rows):
                here = unplaned(col["contexts"][i], 4).astype(np.int64)
                if len(own[i]):
                    here[here >= rare] = rare + np.searchsorted(loose, own[i])[here[here >= rare] - rare]
                places.append(np.repeat(np.searchsorted(words, of_words[i]), unplaned(col["counts"][i], 4).astype(np.int64)) * contexts + here)
                docs.append((unplaned(col["docs"][i], 4) + np.uint64(base)).astype(np.int32))
                times.append(unplaned(col["times"][i], 4).astype(np.int32))
                keys.append(unplaned(col["keys"][i], 8))
                flags.append(np.frombuffer(col["flags"][i], np.uint8))
                base += len(keys[-1])
            del col
            place, doc, time, key, flag = (np.concatenate(x) for x in (places, docs, times, keys, flags))
            del places, docs, times, keys
            # A document may come in several pieces: one number each, in order of keys.
            held, first, number = np.unique(key, return_index=True, return_inverse=True)
            doc = number[doc]
            order = np.argsort(place, kind="stable")
            place, doc, time = place[order], doc[order], time[order]
            dish = np.flatnonzero(np.append(True, place[1:] != place[:-1]))
            word, context = place[dish] // contexts, place[dish] % contexts
            customers = np.add.reduceat(np.where(flag[first][doc] & 1, time, 0), dish).astype(np.int64)
            several = np.flatnonzero(customers > 1)
            where = context[several]
            active = np.unique(where[where >= rare])
            where[where >= rare] = rare + np.searchsorted(active, where[where >= rare])
            out = {
                "words": packed_sorted(words), "dishes": planes(np.bincount(word, minlength=len(words)), 4), "contexts": planes(context, 4), "customers": planes(customers, 5), "rare": packed_sorted(loose),
                "several_words": planes(word[several], 4), "several_contexts": planes(where, 4), "several_customers": planes(customers[several], 5), "active": packed_sorted(loose[active - rare]),
                "ones": planes(np.bincount(word[customers == 1], minlength=len(words)), 4), "entries": planes(np.diff(np.append(dish, len(place))), 4),
                "docs": planes(doc, 4), "times": planes(time, 4), "keys": packed_sorted(held),
            }
        return pa.table({"bucket": pa.array([bucket], pa.int32()), **{c: pa.array([_squeezed(out[c]) if c in out else None], pa.binary()) for c in _STORED}})

    return rows.groupBy("bucket").applyInArrow(run, _STORED_SCHEMA)


def _joined(blobs: list[bytes], width: int) -> bytes:
    return planes(np.concatenate([unplaned(b, width) for b in blobs]), width)


def _written(folder: str, sweep: int, name: str, data: bytes) -> None:
    """Puts a file into the shared folder, whole or not at all; a task that runs again replaces it by the same bytes."""
    files, path = file_system(f"{folder}/{sweep}")
    files.create_dir(path, recursive=True)
    part = f"{path}/.{name}-{uuid.uuid4().hex}"
    with files.open_output_stream(part, compression=None) as out:
        out.write(data)
    files.move(part, f"{path}/{name}")


def _stored(folder: str, sweep: int, name: str) -> bytes:
    files, path = file_system(f"{folder}/{sweep}")
    with files.open_input_file(f"{path}/{name}") as data:
        return data.read()


def _forget(folder: str, sweep: int) -> None:
    files, path = file_system(f"{folder}/{sweep}")
    if files.get_file_info(path).type.name == "Directory":
        files.delete_dir(path)


class Run:
    """Where a run keeps its sweeps, and what does not change: frequent words, sweeps that are averaged, discounts and totals once they are known."""

    def __init__(self, frequent: np.ndarray, folder: str, sweeps: int, averaged: int):
        self.frequent, self.folder, self.sweeps, self.first_averaged = frequent, folder, sweeps, max(sweeps - averaged + 1, 0)

    def whole(self, sweep: int) -> bool:
        """Whether all restaurants are sent after this sweep, not only those with dishes of several customers."""
        return sweep == 0 or sweep >= self.first_averaged


class Block:
    """A block's dishes with several customers as arrays; dishes of one customer are only counted, as they always have one table."""

    def __init__(self, row: dict, run: Run):
        part = {c: _loose(row[c]) for c in _SEVERAL}
        self.number, self.run, self.frequent = row["bucket"], run, len(run.frequent)
        self.words, self.active = unpacked_sorted(part["words"]), unpacked_sorted(part["active"])
        self.word, self.where = unplaned(part["several_words"], 4).astype(np.int64), unplaned(part["several_contexts"], 4).astype(np.int64)
        self.customers, self.ones = unplaned(part["several_customers"], 5).astype(np.int64), unplaned(part["ones"], 4).astype(np.int64)
        at = np.minimum(np.searchsorted(run.frequent, self.words), self.frequent - 1)
        self.index = np.where(run.frequent[at] == self.words, at, -1)  # of each word among the frequent
        self.often = self.index >= 0

    def guests(self, tables: np.ndarray) -> np.ndarray:
        """Customers of each word in the parent."""
        return self.ones + np.bincount(self.word, tables, len(self.words)).astype(np.int64)

    def save(self, sweep: int, tables: np.ndarray, in_parent: np.ndarray, shares: np.ndarray) -> None:
        _written(f"{self.run.folder}/seats", sweep, str(self.number), _squeezed(planes(tables, 5) + planes(in_parent, 5)))
        _written(f"{self.run.folder}/seats", sweep, f"{self.number}-shares", shares.tobytes())

    def load(self, sweep: int) -> tuple[np.ndarray, np.ndarray]:
        """Tables of the dishes with several customers, and of the words in the parent (0 for frequent words), after a sweep; at first one each."""
        n = len(self.customers)
        if sweep == 0:
            tables = np.ones(n, np.int64)
            return tables, np.where(self.often, 0, np.minimum(self.guests(tables), 1))
        data = _loose(_stored(f"{self.run.folder}/seats", sweep, str(self.number)))
        return unplaned(data[: 5 * n], 5).astype(np.int64), unplaned(data[5 * n :], 5).astype(np.int64)

    def shares(self, guests: np.ndarray, in_parent: np.ndarray, discount0: float, sweep: int) -> tuple[np.ndarray, int]:
        """Gamma variables of the words that have dishes with several customers and are not frequent, and the units of all words' together; the others are drawn as one."""
        asked = np.zeros(len(self.words), bool)
        asked[self.word] = True
        asked &= ~self.often
        out = np.zeros(len(self.words))
        out[asked] = word_shares(self.words[asked], guests[asked], in_parent[asked], discount0, sweep)
        rest = ~asked & ~self.often
        shape = float((guests[rest] - discount0 * in_parent[rest]).sum())
        other = S.gammas(np.array([shape]), np.array([self.number + 1], np.uint64), 4 * sweep + _OF_WORD) if shape > 0 else np.zeros(1)
        return out, units(out) + units(other)


class Dishes:
    """All of a block's dishes as arrays."""

    def __init__(self, row: dict, block: Block):
        part = {c: _loose(row[c]) for c in _DISHES}
        self.rare = unpacked_sorted(part["rare"])
        self.word = np.repeat(np.arange(len(block.words)), unplaned(part["dishes"], 4).astype(np.int64))
        self.where, self.customers = unplaned(part["contexts"], 4).astype(np.int64), unplaned(part["customers"], 5).astype(np.int64)
        self.total = np.bincount(self.word, self.customers, len(block.words)).astype(np.int64)
        self.restaurants, self.frequent = block.frequent + len(self.rare), block.frequent
        self.single = self.by_context(self.customers == 1)

    def by_context(self, values: np.ndarray) -> np.ndarray:
        return np.bincount(self.where, values, self.restaurants).astype(np.int64)


class Whole:
    """What all blocks know after a sweep."""

    def __init__(self, run: Run, sums: dict[tuple[str, int], int], sweep: int, before: Whole | None):
        rare = len(run.frequent)
        pick = lambda kind: np.array([sums.get((kind, i), 0) for i in range(rare)], np.int64)
        self.sweep, self.guests = sweep, pick("guests")  # of frequent words
        self.tables = pick("tables") + (pick("single") if before is None else before.single)  # of frequent contexts
        if before is None:
            self.single = pick("single")
            self.customers, self.counts = pick("customers"), pick("counts")
            self.words = sums.get(("words", 0), 0) + int(np.count_nonzero(self.counts))
            estimate = lambda one, two: min(0.9, max(0.05, one / (one + 2 * two))) if one else 0.5
            self.discount = estimate(sums.get(("once", 0), 0), sums.get(("twice", 0), 0))
            self.discount0 = estimate(*(sums.get((k, 0), 0) + int(np.count_nonzero(self.guests == n)) for k, n in (("guest1", 1), ("guest2", 2))))
            self.tokens = sums.get(("tokens", 0), 0)
            self.in_parent = np.minimum(self.guests, 1)
        else:
            for name in ("single", "customers", "counts", "words", "discount", "discount0", "tokens"):
                setattr(self, name, getattr(before, name))
            self.in_parent = S.tables(self.guests, np.full(rare, before.parent_weight()), self.discount0, np.random.default_rng([SEED, sweep]), before.in_parent if sweep > 1 else None)
        self.all_tables = sums.get(("rare_tables", 0), 0) + int(self.in_parent.sum())
        self.all_guests = sums.get(("rare_guests", 0), 0) + int(self.guests.sum())
        # The parent's distribution that the next sweep is given: gamma variables of the words and of what is not seated, over their sum.
        self.shares = word_shares(run.frequent, self.guests, self.in_parent, self.discount0, sweep)
        self.rest = float(S.gammas(np.array([STRENGTH + self.discount0 * self.all_tables]), np.zeros(1, np.uint64), 4 * sweep + _OF_REST)[0])
        self.sum = (sums.get(("shares", 0), 0) + units(self.shares)) * _UNIT + self.rest

    @property
    def base(self) -> float:
        return 1 / (self.words + 1)

    def parent_weight(self) -> float:
        """What a table in the parent weighs in the next sweep."""
        z = S.gammas(np.array([STRENGTH / self.discount0 + self.all_tables]), np.zeros(1, np.uint64), 4 * self.sweep + _OF_PARENT)[0]
        return float(self.discount0 * z * self.base)

    def drawn(self, shares: np.ndarray) -> np.ndarray:
        return (shares + self.rest * self.base) / self.sum

    def parent(self, guests: np.ndarray, in_parent: np.ndarray) -> np.ndarray:
        """The mean of the parent's distribution given the seats."""
        return (guests - self.discount0 * in_parent + (STRENGTH + self.discount0 * self.all_tables) * self.base) / (STRENGTH + self.all_guests)


def word_shares(keys: np.ndarray, guests: np.ndarray, in_parent: np.ndarray, discount0: float, sweep: int) -> np.ndarray:
    out = np.zeros(len(keys))
    some = np.flatnonzero(guests)
    out[some] = S.gammas(guests[some] - discount0 * in_parent[some], keys[some], 4 * sweep + _OF_WORD)
    return out


def units(shares: np.ndarray) -> int:
    return int(np.rint(shares / _UNIT).astype(np.int64).sum())


def swept(block: Block, whole: Whole) -> tuple[np.ndarray, np.ndarray]:
    """The block's state after the sweep that follows `whole`: tables of dishes with several customers, and in the parent those of words that are not frequent."""
    before, in_parent = block.load(whole.sweep)
    often, draw, kept = block.often, np.random.default_rng([SEED, whole.sweep + 1, block.number]), whole.sweep > 0
    guests = np.where(often, 0, block.guests(before))
    if kept:
        chance = whole.drawn(np.where(often, whole.shares[block.index], np.frombuffer(_stored(f"{block.run.folder}/seats", whole.sweep, f"{block.number}-shares"), np.float64)))
    else:  # discounts were not known when sums were sent: the first sweep is given the mean
        chance = whole.parent(np.where(often, whole.guests[block.index], guests), np.where(often, whole.in_parent[block.index], in_parent))
    there = np.zeros(block.frequent + len(block.active), np.int64)
    there[: block.frequent] = whole.tables
    if len(block.active):
        there[block.frequent :] = _totals(block.run, 0, block.number, "single_of_active") + _totals(block.run, whole.sweep, block.number, "tables_of_active")
    z = S.gammas(STRENGTH / whole.discount + there, np.concatenate([block.run.frequent, block.active]), 4 * whole.sweep + _OF_CONTEXT)
    tables = S.tables(block.customers, whole.discount * z[block.where] * chance[block.word], whole.discount, draw, before if kept else None)
    guests = np.where(often, 0, block.guests(tables))
    return tables, S.tables(guests, np.full(len(guests), whole.parent_weight()), whole.discount0, draw, in_parent if kept else None)


def sums_of(block: Block, tables: np.ndarray, in_parent: np.ndarray, guests: np.ndarray, shares: int | None, dishes: Dishes | None = None):
    """What the block adds to the whole: (kind, index, number) of frequent words and of all; `dishes` at first, then the units of its words' `shares`."""
    often, rare = block.often, block.frequent
    vectors = [("tables", np.bincount(block.where, tables, rare + len(block.active))[:rare]), ("guests", np.bincount(block.index[often], guests[often], rare))]
    scalars = [("rare_tables", in_parent.sum()), ("rare_guests", guests[~often].sum())]
    if shares is not None:
        scalars.append(("shares", shares))
    else:
        vectors += [("single", dishes.single[:rare]), ("customers", dishes.by_context(dishes.customers)[:rare]), ("counts", np.bincount(block.index[often], dishes.total[often], rare))]
        scalars += [
            ("words", np.count_nonzero(dishes.total[~often])), ("tokens", dishes.total.sum()), ("once", np.count_nonzero(dishes.customers == 1)), ("twice", np.count_nonzero(dishes.customers == 2)),
            ("guest1", np.count_nonzero(guests[~often] == 1)), ("guest2", np.count_nonzero(guests[~often] == 2)),
        ]
    return [(kind, i, int(values[i])) for kind, values in vectors for i in np.flatnonzero(values).tolist()] + [(kind, 0, int(value)) for kind, value in scalars]


_SENT = ["kind", "place", "n", "block", "contexts", "active", "tables", "single", "customers"]
_SENT_TYPES = [pa.string(), pa.int64(), pa.int64(), pa.int32(), *[pa.binary()] * 5]
_SUMMED = ("tables", "single", "customers")


def swept_sums(state: DataFrame, run: Run, before: Whole | None, blocks: int) -> DataFrame:
    """Does a sweep (the first, of one table a dish, without `before`): blocks keep their seats and send what they add to the whole; for kind 'contexts', a row for each range (place) of contexts,
    of all rare contexts after the first and the averaged sweeps, else of those that have dishes of several customers in the block."""
    sweep = before.sweep + 1 if before else 0
    columns = ["bucket", *(_SEVERAL if not run.whole(sweep) else [*_SEVERAL, *_DISHES[1:]] if sweep == 0 else [*_SEVERAL, "rare"])]

    def go(batches):
        total: dict[tuple[str, int], int] = {}
        for batch in batches:
            for i in range(batch.num_rows):
                row = {c: batch.column(c)[i].as_py() for c in columns}
                block, dishes = Block(row, run), None
                if before is None:
                    (tables, in_parent), dishes = block.load(0), Dishes(row, block)
                else:
                    tables, in_parent = swept(block, before)
                guests, units_of = block.guests(tables), None
                if before is not None:
                    shares, units_of = block.shares(guests, in_parent, before.discount0, sweep)
                    block.save(sweep, tables, in_parent, shares)
                for kind, index, value in sums_of(block, tables, in_parent, guests, units_of, dishes):
                    total[kind, index] = total.get((kind, index), 0) + value
                contexts = unpacked_sorted(_loose(row["rare"])) if run.whole(sweep) else block.active
                at = np.searchsorted(contexts, block.active)
                active, seats = np.zeros(len(contexts), np.uint8), np.zeros(len(contexts), np.int64)
                active[at] = 1
                seats[at] = np.bincount(block.where, tables, block.frequent + len(block.active)).astype(np.int64)[block.frequent :]
                place = hash_range(contexts, blocks)
                start = np.flatnonzero(np.append(True, place[1:] != place[:-1])[: len(place)]).tolist()
                rows = []
                if dishes is not None:
                    single, people = dishes.single[block.frequent :], dishes.by_context(dishes.customers)[block.frequent :]
                for a, b in zip(start, [*start[1:], len(contexts)], strict=True) if start else ():
                    more = (planes(single[a:b], 5), planes(people[a:b], 5)) if dishes is not None else (None, None)
                    rows.append(("contexts", int(place[a]), 0, block.number, packed_sorted(contexts[a:b]), np.packbits(active[a:b]).tobytes(), planes(seats[a:b], 5), *more))
                if rows:
                    yield pa.RecordBatch.from_arrays([pa.array(list(x), t) for x, t in zip(zip(*rows, strict=True), _SENT_TYPES, strict=True)], _SENT)
        if total:
            rows = [(kind, index, value, *[None] * 6) for (kind, index), value in total.items()]
            yield pa.RecordBatch.from_arrays([pa.array(list(x), t) for x, t in zip(zip(*rows, strict=True), _SENT_TYPES, strict=True)], _SENT)
        X.release()

    some = state.where("bucket >= 0").select(*columns)
    return settled(some.mapInArrow(go, "kind string, place long, n long, block int, contexts binary, active binary, tables binary, single binary, customers binary"))


def small_sums(sent: DataFrame) -> dict[tuple[str, int], int]:
    rows = sent.where("kind <> 'contexts'").groupBy("kind", "place").agg(F.sum("n").alias("n"))
    return {(r[0], r[1]): r[2] for r in rows.collect()}  # at most 4 / SHARE and a few


def totals_by_block(sent: DataFrame, run: Run, sweep: int) -> None:
    """Adds up the blocks' numbers of each rare context and keeps for each block the sums of the contexts that it sent, in their order, and of the active ones among them."""

    def add(table: pa.Table) -> pa.Table:
        col = {c: table.column(c).to_pylist() for c in ("block", "contexts", *_SUMMED)}
        held = [unpacked_sorted(x) for x in col["contexts"]]
        _, number = np.unique(np.concatenate(held), return_inverse=True)
        cut = np.cumsum([0, *map(len, held)])
        out = {}
        for c in _SUMMED:
            if col[c][0] is None:
                out[c] = [None] * len(held)
                continue
            sums = np.bincount(number, np.concatenate([unplaned(x, 5) for x in col[c]])).astype(np.int64)[number]
            out[c] = [planes(sums[a:b], 5) for a, b in zip(cut[:-1], cut[1:], strict=True)]
        return pa.table({"block": pa.array(col["block"], pa.int32()), "place": table.column("place"), "active": table.column("active"), **{c: pa.array(out[c], pa.binary()) for c in _SUMMED}})

    def keep(table: pa.Table) -> pa.Table:
        table = table.sort_by("place")
        block, active = table.column("block")[0].as_py(), table.column("active").to_pylist()
        for c in _SUMMED:
            col = table.column(c).to_pylist()
            if col[0] is not None:
                sums = [unplaned(x, 5) for x in col]
                flags = np.concatenate([np.unpackbits(np.frombuffer(f, np.uint8), count=len(x)).astype(bool) for f, x in zip(active, sums, strict=True)])
                sums = np.concatenate(sums)
                _written(f"{run.folder}/totals", sweep, f"{block}-{c}_of_active", _squeezed(planes(sums[flags], 5)))
                if run.whole(sweep):
                    _written(f"{run.folder}/totals", sweep, f"{block}-{c}", _squeezed(planes(sums, 5)))
        return pa.table({"block": pa.array([block], pa.int32())})

    sums = sent.where("kind = 'contexts'").select("place", "block", "contexts", "active", *_SUMMED).groupBy("place").applyInArrow(add, "block int, place long, active binary, tables binary, single binary, customers binary")
    sums.groupBy("block").applyInArrow(keep, "block int").write.format("noop").mode("overwrite").save()


def _totals(run: Run, sweep: int, number: int, kind: str) -> np.ndarray:
    return unplaned(_loose(_stored(f"{run.folder}/totals", sweep, f"{number}-{kind}")), 5).astype(np.int64)


def scores(state: DataFrame, run: Run, wholes: list[Whole], groups: int) -> DataFrame:
    """What each block adds to its documents' sums, from the sweeps `wholes`, added up with the groups of documents themselves."""
    names = ["grp", "keys", "score", "base", "known", "ids", "sizes", "flags"]
    kinds = [pa.int32(), *[pa.binary()] * 7]

    def go(batches):
        for batch in batches:
            for i in range(batch.num_rows):
                row = {c: batch.column(c)[i].as_py() for c in batch.schema.names}
                if row["bucket"] < 0:
                    yield pa.RecordBatch.from_arrays(
                        [pa.array([x], t) for x, t in zip((-1 - row["bucket"], _loose(row["keys"]), None, None, None, _loose(row["ids"]), _loose(row["sizes"]), _loose(row["flags"])), kinds, strict=True)], names
                    )
                    continue
                X.release()
                block, one = Block(row, run), wholes[0]
                dishes, often = Dishes(row, block), block.often
                rare = len(dishes.rare) > 0
                of = lambda kind, sweep: _totals(run, sweep, block.number, kind) if rare else np.zeros(0, np.int64)  # noqa: B023, E731
                customers, single = np.concatenate([one.customers, of("customers", 0)]), of("single", 0)
                several, tables = np.flatnonzero(dishes.customers > 1), np.minimum(dishes.customers, 1)
                mean = np.zeros(len(dishes.word))
                for whole in wholes:
                    seats, in_parent = block.load(whole.sweep)
                    tables[several] = seats
                    chance = whole.parent(np.where(often, whole.guests[block.index], block.guests(seats)), np.where(often, whole.in_parent[block.index], in_parent))[dishes.word]
                    all_tables = np.concatenate([whole.tables, single + of("tables", whole.sweep)])
                    mean += (dishes.customers - whole.discount * tables + (STRENGTH + whole.discount * all_tables[dishes.where]) * chance) / (STRENGTH + customers[dishes.where])
                logs = np.log(mean / len(wholes)) / _LN10
                count = np.where(often, one.counts[block.index], dishes.total)
                plain = np.log10((count + 0.5) / (one.tokens + 0.5 * (one.words + 1)))
                dish = np.repeat(np.arange(len(dishes.word)), unplaned(_loose(row["entries"]), 4).astype(np.int64))
                doc, times, keys = unplaned(_loose(row["docs"]), 4).astype(np.int64), unplaned(_loose(row["times"]), 4).astype(np.int64), unpacked_sorted(_loose(row["keys"]))
                n = len(keys)
                score = np.bincount(doc, times * logs[dish], n)
                base = np.bincount(doc, times * plain[dishes.word[dish]], n)
                known = np.bincount(doc, times * (count > 0)[dishes.word[dish]], n).astype(np.int64)
                group = (X.mix(keys) % np.uint64(groups)).astype(np.int64)
                order = np.argsort(group, kind="stable")
                start = np.flatnonzero(np.append(True, group[order][1:] != group[order][:-1])).tolist()
                rows = []
                for a, b in zip(start, [*start[1:], n], strict=True):
                    at = order[a:b]
                    rows.append((int(group[at[0]]), planes(keys[at], 8), score[at].tobytes(), base[at].tobytes(), planes(known[at], 4), None, None, None))
                yield pa.RecordBatch.from_arrays([pa.array(list(x), t) for x, t in zip(zip(*rows, strict=True), kinds, strict=True)], names)

    def add(table: pa.Table) -> pa.Table:
        col = {c: table.column(c).to_pylist() for c in names[1:]}
        own = [i for i in range(table.num_rows) if col["ids"][i] is not None]
        key = np.concatenate([unplaned(col["keys"][i], 8) for i in own]) if own else np.zeros(0, np.uint64)
        ids = np.concatenate([unplaned(col["ids"][i], 8) for i in own]).view(np.int64)
        size = np.concatenate([unplaned(col["sizes"][i], 5) for i in own]).astype(np.int64)
        flag = np.concatenate([np.frombuffer(col["flags"][i], np.uint8) for i in own])
        order = np.argsort(key)
        key, ids, size, flag = key[order], ids[order], size[order], flag[order]
        score, base, known = np.zeros(len(key)), np.zeros(len(key)), np.zeros(len(key), np.int64)
        rest = [i for i in range(table.num_rows) if col["ids"][i] is None]
        rest.sort(key=lambda i: (col["keys"][i], col["score"][i]))  # sums in the same order whatever order rows arrive in
        for i in rest:
            at = np.searchsorted(key, unplaned(col["keys"][i], 8))
            score[at] += np.frombuffer(col["score"][i], np.float64)
            base[at] += np.frombuffer(col["base"][i], np.float64)
            known[at] += unplaned(col["known"][i], 4).astype(np.int64)
        return pa.table(
            {"id": pa.array(ids, mask=(flag & 2) == 0), "held_out": pa.array((flag & 1) == 0), "n_tokens": pa.array(size), "n_known": pa.array(known), "base_score": pa.array(base), "score": pa.array(score)}
        )

    made = state.mapInArrow(go, "grp int, keys binary, score binary, base binary, known binary, ids binary, sizes binary, flags binary")
    return made.groupBy("grp").applyInArrow(add, "id long, held_out boolean, n_tokens long, n_known long, base_score double, score double")


def score_texts(df: DataFrame, held_out, text: str = "text", id_column: str = "doc_id", sweeps: int = SWEEPS, averaged: int = AVERAGED) -> DataFrame:
    """Learns from the rows where `held_out` (a column expression) is not true and scores all: the id column (as long), held_out,
    n_tokens, n_known, train_tokens, base_score, score, log10_perplexity. The last `averaged` of the `sweeps` count."""
    spark = df.sparkSession
    source = df.select(
        df[X.quoted(id_column)].cast("long").alias("id"), (~F.coalesce(held_out, F.lit(False))).alias("train"), df[X.quoted(text)].cast("string").alias("text"),
        F.monotonically_increasing_id().alias("key"),
    )
    frequent, total = frequent_words(source.select("train", "text"), SHARE)
    blocks = max(64, -(-total // BLOCK_TOKENS))
    groups = max(64, -(-total // (500 * GROUP_DOCS)))
    run = Run(frequent, shared_path(spark, "language-model"), sweeps, averaged)
    assembled(dealt(source, frequent, blocks, groups), len(frequent)).write.option("compression", "none").parquet(f"{run.folder}/state")
    state = spark.read.schema(_STORED_SCHEMA).parquet(f"{run.folder}/state")
    whole, counted = None, []
    for sweep in range(sweeps + 1):
        sent = swept_sums(state, run, whole, blocks)
        totals_by_block(sent, run, sweep)
        whole = Whole(run, small_sums(sent), sweep, whole)
        if sweep >= run.first_averaged:
            counted.append(whole)
        if 1 < sweep <= run.first_averaged:  # nobody reads the sweep before any more
            _forget(f"{run.folder}/seats", sweep - 1)
            _forget(f"{run.folder}/totals", sweep - 1)
    made = scores(state, run, counted, groups)
    return made.select(
        F.col("id").alias(id_column), "held_out", "n_tokens", "n_known", F.lit(whole.tokens).cast("long").alias("train_tokens"), "base_score", "score",
        (-F.col("score") / F.col("n_tokens")).alias("log10_perplexity"),
    )
