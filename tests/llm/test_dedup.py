"""Exact copies, fingerprints, near copies, repeated strings: against brute force."""

import hashlib
import itertools
import re
import unicodedata

import numpy as np
import pytest
from pyspark.sql import functions as F

from histospark.llm import exact_dedup as ed
from histospark.llm import regions as rg
from histospark.llm.fingerprints import fingerprint_edits, fingerprints, successors
from histospark.llm.jaccard_join import distinct_documents, jaccard_components
from histospark.llm.regions import Region
from histospark.llm.shingles import linked, shingle_sets
from histospark.llm.suffix_dedup import maximal_intervals, merged, remove_repeats, repeats, sliding_min, suffix_array


def sha(b):
    return hashlib.sha256(b if isinstance(b, bytes) else b.encode()).hexdigest()


def test_exact_dedup(docs, rows):
    folded = {i: re.sub(r"[\x20\x09-\x0D]+", " ", t or "") for i, t in rows}
    for r in ed.exact_dedup(docs).collect():
        own = [i for i, t in folded.items() if t == folded[r["doc_id"]]]
        assert (r["keep_id"], r["group_size"], r["kept"], r["text_sha256"]) == (min(own), len(own), r["doc_id"] == min(own), sha(folded[r["doc_id"]]))
    kept = ed.kept_documents(docs)
    assert kept.columns == docs.columns and kept.count() == len(set(folded.values()))


def test_colliding_hashes_are_told_apart(spark):
    rows = spark.createDataFrame([(i, t) for i, t in enumerate(["a", "b", "a", "c", "b"])], "_id long, _content string")
    same = ed.content_groups(rows, lanes=lambda c: (F.length(c).cast("long"), F.lit(0).cast("long")))
    assert {r["_id"]: (r["_keep"], r["_size"]) for r in same.collect()} == {0: (0, 2), 2: (0, 2), 1: (1, 2), 4: (1, 2), 3: (3, 1)}


def test_dedup_of_odd_rows(odd, empty):
    got = sorted((r["doc_id"] is None, r["doc_id"] or 0, r["keep_id"], r["group_size"], r["kept"]) for r in ed.exact_dedup(odd).collect())
    assert got == [(False, 2, 2, 3, True), (False, 5, 5, 3, False), (False, 5, 5, 3, True), (False, 7, 2, 3, False), (True, 0, 2, 3, False), (True, 0, 5, 3, False)]
    assert ed.exact_dedup(empty).count() == 0 and ed.kept_documents(empty).count() == 0
    assert sorted((r["doc_id"], r["text"]) for r in ed.kept_documents(odd).collect()) == [(2, None), (5, "same text")]


@pytest.fixture(scope="session")
def again(spark):
    """Rows that repeat ids: with the same text, with other texts, without an id; one column has the name of the numbers."""
    long = " ".join(f"w{i}" for i in range(90))
    rows = [(1, long), (1, long), (2, long), (2, "b"), (3, "b"), (3, "c c"), (3, "c  c"), (4, None), (4, ""), (None, "d"), (None, "d"), (None, long), (6, "e" * 300), (6, "e" * 300 + "f")]
    return spark.createDataFrame([(*r, k) for k, r in enumerate(rows)], "doc_id long, text string, _row long"), rows


def test_one_row_of_each_text_stays(again):
    docs, rows = again
    fold = lambda t: re.sub(r"[\x20\x09-\x0D]+", " ", t or "")
    texts = {fold(t) for _, t in rows}
    kept = ed.kept_documents(docs)
    assert kept.columns == docs.columns
    got = [(r["doc_id"], fold(r["text"])) for r in kept.collect()]
    want = [(min((i for i, u in rows if fold(u) == t and i is not None), default=None), t) for t in texts]
    assert sorted(map(repr, got)) == sorted(map(repr, want))
    out = ed.exact_dedup(docs).collect()
    assert len(out) == len(rows) and sum(r["kept"] for r in out) == len(texts) == len({r["text_sha256"] for r in out if r["kept"]})
    assert all(r["doc_id"] == r["keep_id"] for r in out if r["kept"])


def canonical(t):
    nfkc = lambda x: unicodedata.normalize("NFKC", x)
    return re.sub(r"\s+", " ", nfkc(nfkc(t).casefold())).strip()


def test_fingerprints(docs, rows):
    got = {r["doc_id"]: r for r in fingerprint_edits(docs).collect()}
    assert len(got) == len(rows)
    texts = [t or "" for _, t in rows]
    for k, (i, _) in enumerate(rows):
        t, after = texts[k], texts[(k + 1) % len(rows)]
        half = len(t) // 2
        edited = t[: len(t) - half] + after[:half]
        r = got[i]
        assert (r["n_chars"], r["edited_sha256"]) == (len(t), sha(edited))
        assert r["near_edited"] == float(canonical(edited) == canonical(t)) and r["near_next"] == float(canonical(after) == canonical(t))
        same = [j for (j, _), u in zip(rows, texts, strict=True) if canonical(u) == canonical(t)]
        assert (r["group_id"], r["group_size"]) == (min(same), len(same))
        assert all(got[j]["fingerprint"] == r["fingerprint"] for j in same)
        assert (r["edited_fingerprint"] == r["fingerprint"]) == (canonical(edited) == canonical(t))


def test_fingerprints_of_odd_rows(odd, empty):
    assert fingerprint_edits(odd).count() == 6 and fingerprints(odd).count() == 6
    assert fingerprint_edits(empty).count() == 0


def test_fingerprints_of_repeated_ids(again):
    """Some order of the rows of an id gives the edited texts."""
    docs, rows = again
    got = fingerprint_edits(docs).collect()
    assert len(got) == len(rows)
    known = sorted((i, t or "") for i, t in rows if i is not None)
    by_id = [[t for j, t in known if j == i] for i in sorted({i for i, _ in known})]
    want = sorted((r["doc_id"], r["n_chars"], r["edited_sha256"]) for r in got if r["doc_id"] is not None)
    found = False
    for orders in itertools.product(*[sorted(set(itertools.permutations(x))) for x in by_id]):
        texts = [(i, t) for i, x in zip(sorted({i for i, _ in known}), orders, strict=True) for t in x]
        edited = []
        for k, (i, t) in enumerate(texts):
            after, half = texts[(k + 1) % len(texts)][1], len(t) // 2
            edited.append((i, len(t), sha(t[: len(t) - half] + after[:half])))
        found |= sorted(edited) == want
    assert found


@pytest.mark.parametrize("keys", [[], [5], [1, 2, 3], [-(1 << 62), -7, 0, 9, 1 << 40, (1 << 62) + 5], list(range(0, 5000, 3))])
def test_successors(spark, keys):
    got = {r["k"]: r["next"] for r in successors(spark.createDataFrame([(k,) for k in keys], "k long")).collect()}
    assert got == {k: keys[(i + 1) % len(keys)] for i, k in enumerate(keys)}


def word_sets(rows):
    out = {}
    for i, t in rows:
        w = re.findall(rb"[^\x20\x09-\x0D]+", re.sub(rb"[A-Z]", lambda m: m[0].lower(), (t or "").encode()))
        out[i] = {tuple(w[k : k + 5]) for k in range(len(w) - 4)} if len(w) >= 5 else ({tuple(w)} if w else set())
    return out


def brute_components(sets):
    parent = {i: i for i in sets}

    def root(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for i in sets:
        for j in sets:
            if i < j and sets[i] and sets[j] and linked(len(sets[i] & sets[j]), len(sets[i]), len(sets[j])):
                a, b = root(i), root(j)
                parent[max(a, b)] = min(a, b)
    return {i: root(i) for i in sets}


def test_jaccard_components(docs, rows):
    sets = word_sets(rows)
    want = brute_components(sets)
    got = {r["doc_id"]: (r["n_shingles"], r["component_id"]) for r in jaccard_components(docs).collect()}
    assert got == {i: (len(sets[i]), want[i]) for i in sets}
    assert len(set(want.values())) < len(want) - 5


def test_jaccard_of_odd_rows(odd, empty):
    got = sorted((r["doc_id"] or 0, r["n_shingles"], r["component_id"] or 0) for r in jaccard_components(odd).collect())
    assert got == [(0, 0, 0), (0, 1, 5), (2, 0, 2), (5, 1, 5), (5, 1, 5), (7, 0, 7)]
    assert jaccard_components(empty).count() == 0


def test_regions_join_exactly():
    rng = np.random.default_rng(4)
    for trial in range(30):
        base = [np.unique(rng.integers(0, 60, rng.integers(4, 40))).astype(np.uint64) for _ in range(6)]
        sets = [np.unique(np.where(rng.random(len(b)) < 0.08, rng.integers(0, 60, len(b)), b)).astype(np.uint64) for b in base for _ in range(8)]
        unique = [np.array(s, np.uint64) for s in sorted({tuple(s.tolist()) for s in sets})]
        got = Region(unique).join()
        want = brute_components({i: set(s.tolist()) for i, s in enumerate(unique)})
        assert [got[i] for i in range(len(unique))] == [want[i] for i in range(len(unique))], trial


def families(seed, n_families=5, size=30):
    """Sets about common ones: near copies, sets that share much without being similar, chains, and single ones."""
    rng = np.random.default_rng(seed)
    fresh = iter(range(1000, 10**9))
    out = []
    for k in range(n_families):
        base = [next(fresh) for _ in range(rng.integers(20, 60))]
        for i in range(size):
            own = rng.integers(0, len(base) // (2 if k % 2 else 6))
            out.append([*base[own:], *[next(fresh) for _ in range(own)]])
            if k == 2 and i:
                base = base[2:] + [next(fresh), next(fresh)]
    out += [[next(fresh) for _ in range(rng.integers(1, 30))] for _ in range(size)] + [[7], [7, 8], [7, 8, 9, 10], [7, 8, 9]]
    return [np.array(s, np.uint64) * np.uint64(0x9E3779B97F4A7C15) for s in out]


def distinct_sets(seed):
    return [np.array(s, np.uint64) for s in sorted({tuple(np.unique(s).tolist()) for s in families(seed)})]


def groups(root_of):
    out = {}
    for x, r in root_of.items():
        out.setdefault(r, set()).add(x)
    return sorted(sorted(g) for g in out.values())


@pytest.mark.parametrize("entries, growth", [(10**9, 4), (900, 10**6), (900, 4), (300, 0)])
def test_split_regions_join_exactly(spark, monkeypatch, entries, growth):
    monkeypatch.setattr(rg, "REGION_ENTRIES", entries)
    monkeypatch.setattr(rg, "GROWTH", growth)
    monkeypatch.setattr(rg, "DEPTH", 3)
    monkeypatch.setattr(rg, "PIVOTS", 8)
    sets = distinct_sets(11)
    rows = [(k % 2, 10 * k, len(s), 10 * k, True, s.tobytes()) for k, s in enumerate(sets)]
    found = rg.joined(spark.createDataFrame(rows, rg.MEMBER)).collect()
    parent = {10 * k: 10 * k for k in range(len(sets))}
    parent |= {r["set_id"]: r["root"] for r in found}
    assert len(found) == len({r["set_id"] for r in found})
    want = {}
    for half in (0, 1):
        want |= {10 * k: (half, r) for k, r in brute_components({k: set(s.tolist()) for k, s in enumerate(sets) if k % 2 == half}).items()}
    assert groups(parent) == groups(want) and max(map(len, groups(want))) > 5


@pytest.mark.parametrize("seed", [1, 2, 3])
def test_cells_lose_no_pair(seed):
    """Of each linked pair one is at home in a cell that has the other."""
    sets = [set(s.tolist()) for s in distinct_sets(seed)]
    rng = np.random.default_rng(seed)
    pivots = rng.choice(len(sets), 12, replace=False)
    far = np.array([[1 - len(s & sets[p]) / len(s | sets[p]) for p in pivots] for s in sets], np.float32)
    placed = [rg.cells(f, bool(rng.integers(0, 2))) for f in far]
    homes = [{c for c, own in p if own} for p in placed]
    assert all(len(h) <= 1 for h in homes)
    for x in range(len(sets)):
        for y in range(x):
            if (homes[x] or homes[y]) and linked(len(sets[x] & sets[y]), len(sets[x]), len(sets[y])):
                assert any(c in {d for d, _ in placed[y]} for c in homes[x]) or any(c in {d for d, _ in placed[x]} for c in homes[y])


def test_a_shared_core_takes_time_by_number():
    """Sets that share a core, all similar or none, take time in proportion to their number, not to its square."""
    import time

    def took(n, own):
        core = np.arange(300 - own, dtype=np.uint64)
        region = Region([np.concatenate([core, np.arange(1000 + own * k, 1000 + own * k + own, dtype=np.uint64)]) for k in range(n)])
        began = time.process_time()
        assert len(set(region.join())) == (1 if own < 40 else n)
        return time.process_time() - began

    for own in (18, 60):
        took(200, own)
        assert took(8000, own) < 10 * took(2000, own) + 0.5


def test_components_of_small_blocks(spark, docs, rows, monkeypatch):
    from histospark.llm import jaccard_join as jj

    monkeypatch.setattr(jj, "BLOCK_ENTRIES", 600)
    monkeypatch.setattr(rg, "REGION_ENTRIES", 500)
    want = brute_components(word_sets(rows))
    assert {r["doc_id"]: r["component_id"] for r in jaccard_components(docs).collect()} == want


def test_one_document_of_each_group_stays(spark, docs, rows, again, odd, empty):
    want = brute_components(word_sets(rows))
    kept = distinct_documents(docs)
    assert kept.columns == docs.columns and sorted(r["doc_id"] for r in kept.collect()) == sorted(set(want.values()))
    repeated, texts = again
    got = distinct_documents(repeated)
    assert got.columns == repeated.columns
    left = [(r["doc_id"], r["text"]) for r in got.collect()]
    sets = word_sets(list(enumerate(t for _, t in texts)))
    roots = brute_components(sets)
    for root in set(roots.values()):
        members = [k for k in roots if roots[k] == root]
        if sets[root]:
            ids = [texts[k][0] for k in members if texts[k][0] is not None]
            assert sum(left.count(texts[k]) for k in {texts[k]: k for k in members}.values()) == 1
            assert any(left.count(texts[k]) for k in members if texts[k][0] == (min(ids) if ids else None))
    assert sum(not (t or "").split() for _, t in left) == sum(not (t or "").split() for _, t in texts)
    assert sorted((r["doc_id"] or 0, r["text"] or "") for r in distinct_documents(odd).collect()) == [(0, ""), (2, ""), (5, "same text"), (7, "")] and distinct_documents(empty).count() == 0


def test_shingles_do_not_depend_on_blocks():
    import pyarrow as pa

    texts = ["a b c d e f", "A B c D e F", "", None, "one", "x\x0by\x0cz"]
    alone = [next(iter(shingle_sets(pa.array([t], pa.string())))).tolist() for t in texts]
    assert [s.tolist() for s in shingle_sets(pa.array(texts, pa.string()))] == alone
    assert alone[0] == alone[1] and [len(s) for s in alone] == [2, 2, 0, 0, 1, 1]


def brute_removal(rows):
    seen, out = set(), {}
    for i, t in sorted(rows):
        b = (t or "").encode()
        cover = np.zeros(len(b), bool)
        for p in range(len(b) - 99):
            w = b[p : p + 100]
            if w in seen:
                cover[p : p + 100] = True
            seen.add(w)
        runs = int((np.diff(np.concatenate([[0], cover.astype(int)])) == 1).sum())
        out[i] = (len(b), int(cover.sum()), runs, sha(np.frombuffer(b, np.uint8)[~cover].tobytes()))
    return out


def test_repeated_strings(docs, rows):
    got = {r["doc_id"]: tuple(r)[1:] for r in remove_repeats(docs).collect()}
    assert got == brute_removal(rows)
    whole = remove_repeats(docs, contents=True).where("n_spans > 0").first()
    assert len(whole["kept"]) == whole["n_bytes"] - whole["n_removed"] and len(whole["spans"]) == whole["n_spans"]


def test_repeats_of_odd_rows(odd, empty):
    assert remove_repeats(odd).count() == 6 and remove_repeats(empty).count() == 0


def test_rows_that_repeat_an_id_lose_no_text(again, spark):
    docs, rows = again
    got = [r for r in remove_repeats(docs, contents=True).collect()]
    known = sorted((i, t or "") for i, t in rows if i is not None)
    assert len(got) == len(rows) and all(r["n_removed"] == 0 for r in got if r["doc_id"] is None)
    assert sum(rows[0][1].encode() in bytes(r["kept"]) for r in got if r["doc_id"]) == 1
    for i in {i for i, _ in known}:  # any order of the rows of an id may be taken
        texts = [t for j, t in known if j == i]
        before = [(j, t) for j, t in known if j < i]
        own = sorted(tuple(r)[1:5] for r in got if r["doc_id"] == i)
        found = []
        for order in itertools.permutations(texts):
            named = [(k, t) for k, (_, t) in enumerate(before)] + [(len(before) + k, t) for k, t in enumerate(order)]
            out = brute_removal(named)
            found.append(sorted(out[len(before) + k] for k in range(len(order))))
        assert own in found
    t = "".join(chr(97 + k * k % 23) + chr(97 + k % 19) for k in range(150))
    copies = spark.createDataFrame([(1, t), (1, t), (2, "u"), (3, t)], "doc_id long, text string")
    assert sorted(tuple(r)[:3] for r in remove_repeats(copies).collect()) == [(1, 300, 0), (1, 300, 300), (2, 1, 0), (3, 300, 300)]


@pytest.mark.parametrize("split", [3, 40])
def test_hot_anchors_are_split(spark, monkeypatch, split):
    from histospark.llm import suffix_dedup as sd

    rng = np.random.default_rng(5)
    letters = lambda n: "".join(map(chr, rng.integers(97, 115, n)))
    passage = letters(260)
    texts = [letters(rng.integers(0, 90)) + passage[rng.integers(0, 60) : 200 + rng.integers(0, 60)] + letters(rng.integers(0, 90)) for _ in range(90)]
    texts += texts[:10] + ["ab" * 300, "abcab" * 90, "b" * 700, letters(99), letters(100)]
    rows = list(enumerate(texts))
    monkeypatch.setattr(sd, "SPLIT", split)
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(5)
    assert {r["doc_id"]: tuple(r)[1:] for r in sd.remove_repeats(docs).collect()} == brute_removal(rows)


@pytest.mark.parametrize("split", [5, 2000])
def test_repeat_groups_have_all_occurrences(spark, monkeypatch, split):
    """Each group's string is at its places and nowhere else in the corpus, and every repeated window is in one."""
    from histospark.llm import suffix_dedup as sd

    rng = np.random.default_rng(6)
    letters = lambda n: "".join(map(chr, rng.integers(97, 115, n)))
    passage, other = letters(420), letters(150)
    texts = [letters(rng.integers(0, 60)) + passage[rng.integers(0, 90) : 330 + rng.integers(0, 90)] + letters(rng.integers(0, 60)) for _ in range(14)]
    texts += texts[:4] + [other, other + "x", "y" + other + passage, "ab" * 120, None, letters(300)]
    monkeypatch.setattr(sd, "SPLIT", split)
    got = sd.repeat_groups(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").repartition(3)).collect()
    raw = [(t or "").encode() for t in texts]
    strings, places = {}, {}
    for r in got:
        strings.setdefault(r["repeat_id"], set()).add(raw[r["doc_id"]][r["start"] : r["start"] + r["size"]])
        places.setdefault(r["repeat_id"], []).append((r["doc_id"], r["start"]))
    for k, own in strings.items():
        (string,) = own
        at = [(d, i) for d, t in enumerate(raw) for i in range(len(t)) if t.startswith(string, i)]
        assert len(string) >= 100 and len(at) > 1 and sorted(places[k]) == at
    windows = {}
    for d, t in enumerate(raw):
        for i in range(len(t) - 99):
            windows.setdefault(t[i : i + 100], []).append((d, i))
    held = {s[i : i + 100] for own in strings.values() for s in own for i in range(len(s) - 99)}
    assert held == {w for w, at in windows.items() if len(at) > 1}


def test_parts_of_a_stretch_hold_all_windows():
    from histospark.llm import suffix_dedup as sd

    rng = np.random.default_rng(3)
    content = bytes(rng.integers(97, 123, 150).astype(np.uint8))
    for level in range(1, 8):
        held = sorted(first + k for _, first, _, part in sd.parts(content, 70, level) for k in range(len(part) - 99))
        assert held == list(range(51)) and all(content[first : first + len(part)] == part and first + at == 70 for _, first, at, part in sd.parts(content, 70, level))
        if level == 7:
            assert all(len(part) == 100 for _, _, _, part in sd.parts(content, 70, level))


def test_suffix_arrays_and_intervals():
    rng = np.random.default_rng(8)
    data = rng.integers(97, 99, 300).astype(np.uint8)
    starts = np.arange(0, 300, 1)
    order, common = suffix_array(data, starts)
    raw = data.tobytes()
    padded = raw + b"\0" * 600
    assert [padded[i : i + 256] for i in order] == sorted(padded[i : i + 256] for i in starts)
    for a, b, n in zip(order[:-1], order[1:], common[1:], strict=True):
        assert padded[a : a + n] == padded[b : b + n] and (n == 255 or padded[a + n] != padded[b + n])
    texts = [bytes(rng.integers(97, 100, 40).astype(np.uint8)) for _ in range(6)]
    got = {(size, tuple(sorted(zip(d.tolist(), s.tolist(), strict=True)))) for size, d, s in repeats(texts, 3)}
    want = set()
    for text in texts:
        for i in range(40):
            for n in range(3, 41 - i):
                w = text[i : i + n]
                at = [(d, k) for d, t in enumerate(texts) for k in range(len(t) - n + 1) if t[k : k + n] == w]
                before = {texts[d][k - 1] if k else (d, k) for d, k in at}
                behind = {texts[d][k + n] if k + n < 40 else (d, k) for d, k in at}
                if len(at) > 1 and len(before) > 1 and len(behind) > 1:
                    want.add((n, tuple(sorted(at))))
    assert got == want
    assert list(maximal_intervals(np.array([0, 5, 5, 3]), np.array([1, 1, 1, 1]), 3)) == []


def test_small_helpers():
    keys = np.random.default_rng(2).integers(0, 99, 50).astype(np.uint64)
    for width in (1, 2, 7, 50):
        assert sliding_min(keys, width).tolist() == [int(keys[i : i + width].min()) for i in range(51 - width)]
    assert merged([(5, 3), (0, 2), (2, 1), (7, 2)]) == [(0, 3), (5, 9)]


def test_stretches_part_all_windows(monkeypatch):
    from histospark.llm import suffix_dedup as sd

    rng = np.random.default_rng(11)
    texts = [bytes(rng.integers(97, 110, n).astype(np.uint8)) for n in (0, 99, 100, 101, 3000, 5, 1234)]
    texts[6] = texts[4][500:1500] + texts[6]
    ids = [(i, 0) for i in range(7)]
    whole = sd.stretches(ids, texts)
    monkeypatch.setattr(sd, "BLOCK_BYTES", 400)
    for found in (whole, sd.stretches(ids, texts)):
        for i, t in enumerate(texts):
            own = found[found["doc"] == i]
            starts = sorted(s for r in own for s in range(r["start"], r["start"] + r["size"] - 99))
            assert starts == list(range(max(0, len(t) - 99)))
        anchors = {}
        for r in found:
            for s in range(r["start"], r["start"] + r["size"] - 99):
                anchors.setdefault(texts[r["doc"]][s : s + 100], set()).add(int(r["anchor"]))
        assert all(len(a) == 1 for a in anchors.values())
