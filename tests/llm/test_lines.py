import numpy as np

from marketloom.llm import lines


def distance(a, b):
    row = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        before, row[0] = row[0], i
        for j, y in enumerate(b, 1):
            before, row[j] = row[j], min(row[j] + 1, row[j - 1] + 1, before + (x != y))
    return row[-1]


def plain(rows):
    """Removed line numbers of each (id, text), by comparing every two lines whose lengths allow it; :func:`distance` holds the comparison."""
    found = {}
    places = []
    for k, t in sorted(set(r for r in rows if r[1] is not None), key=lambda r: (r[0] is not None, r[0] or 0)):
        for n, words in enumerate(lines.normalised(t)):
            if len(words) >= lines.MIN_WORDS:
                places.append(((k is not None, k or 0, n), (k, t), n, b" ".join(words), words))
    texts = sorted({p[3] for p in places}, key=lambda t: (len(t), t))
    spaces = [t.count(b" ") for t in texts]
    label = {t: t for t in texts}

    def root(t):
        while label[t] != t:
            t = label[t]
        return t

    for i, a in enumerate(texts):
        for k in range(i + 1, len(texts)):
            b = texts[k]
            if len(b) - len(a) > (1 - lines.SIMILARITY) * len(b) + 1e-9:
                break
            if min(spaces[i], spaces[k]) + 1 >= lines.FUZZY_WORDS and lines.edit_similar(a, b):
                label[root(b)] = root(a)
    first = {}
    for place, row, n, text, _ in sorted(places, key=lambda p: p[0]):
        g = root(text)
        if first.setdefault(g, (row, n)) != (row, n):
            found.setdefault(row, []).append(n)
    return found


def test_edit_similarity():
    rng = np.random.default_rng(8)
    for _ in range(1500):
        a = bytes(rng.choice(list(b"abc "), rng.integers(0, 40)).tolist())
        b = bytearray(a)
        for _ in range(rng.integers(0, 9)):
            at = int(rng.integers(0, len(b) + 1))
            if rng.random() < 0.5:
                b.insert(at, 120)
            elif at < len(b):
                del b[at]
        b = bytes(b)
        assert lines.edit_similar(a, b) == (distance(a, b) <= int(0.2 * max(len(a), len(b)) + 1e-9)), (a, b)


def test_pairs_set_aside_together():
    """Lines of the same words in another order are told apart many at once; none that is similar is lost."""
    rng = np.random.default_rng(31)
    words = ["".join(rng.choice(list("abcdefgh"), rng.integers(2, 8))) for _ in range(30)]
    bodies = [" ".join(rng.choice(words, rng.integers(1, 90))).encode() for _ in range(300)] + [b"", "größe ñ 0".encode() * 20, b"a" * 3000]
    for k in range(0, 300, 2):  # some near the bound, of every size
        changed = bytearray(bodies[k])
        for _ in range(int(rng.uniform(0, 0.3) * len(changed))):
            at = int(rng.integers(0, len(changed) + 1))
            changed[at : at + int(rng.integers(0, 2))] = bytes(rng.choice(list(b"xyz "), rng.integers(0, 2)).tolist())
        bodies.append(b" ".join(bytes(changed).split()))
    i, j = np.divmod(np.arange(len(bodies) ** 2), len(bodies))
    size = np.array([len(b) for b in bodies])
    near = (5 * np.minimum(size[i], size[j]) >= 4 * np.maximum(size[i], size[j])) & (rng.random(len(i)) < 0.1) | ((j == i // 2 + 303) & (i < 300) & (i % 2 == 0))
    i, j = i[near], j[near]
    apart = lines.surely_apart(bodies, i, j)
    similar = np.array([lines.edit_similar(bodies[p], bodies[q]) for p, q in zip(i, j)])
    assert not (apart & similar).any() and similar.sum() > 60
    long = size[i] > 2 * lines.WORD
    assert (apart | similar)[long].mean() > 0.9
    assert all(distance(bodies[p], bodies[q]) > 0.2 * max(size[p], size[q]) for p, q in list(zip(i[apart], j[apart]))[:15])


def test_small_tables(spark):
    rng = np.random.default_rng(9)
    words = ["alpha", "beta", "gamma", "delta", "epsilon", "zeta", "eta", "theta", "iota", "kappa", "lambda", "mu"]
    stock = [" ".join(rng.choice(words, rng.integers(5, 14))) for _ in range(25)]
    rows = []
    for k in range(60):
        body = []
        for _ in range(rng.integers(1, 6)):
            line = stock[rng.integers(len(stock))]
            if rng.random() < 0.3:
                line = line.replace("a", "A", 1) + "!"
            if rng.random() < 0.3:
                line = line + "s"
            body.append(line)
        rows.append((k, "\n".join([*body, "short line"])))
    rows += [(100, None), (101, ""), (102, "\n\n"), (3, rows[3][1]), (None, stock[0])]
    docs = spark.createDataFrame([(*r, 1, "x") for r in rows], "doc_id long, text string, removed int, gone string")
    want = plain(rows)
    out = lines.dedup_lines(docs, count="n_removed")
    assert out.columns == [*docs.columns, "n_removed"]

    def kept(row):
        if row[1] is None:
            return None
        return "\n".join(x for n, x in enumerate(row[1].split("\n")) if n not in want.get(row, []))

    assert sorted(((r.doc_id, r.text) for r in out.collect()), key=str) == sorted(((r[0], kept(r)) for r in rows), key=str)
    assert lines.dedup_lines(docs.limit(0)).count() == 0


def test_documents(spark, sf_dir):
    rows = [(r.doc_id, r.text) for r in spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text").where("length(text) < 1500").limit(120).collect()]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    got = {(r.doc_id, r.n) for r in lines.removed_lines(docs).select("doc_id", lines.F.explode("removed").alias("n")).collect()}
    assert got == {(k, n) for (k, _), ns in plain(rows).items() for n in ns}


def test_links_follow_edit_similarity_alone(spark):
    """Lines with changed words or letters, similarity 0.8 to 0.95: the gate may lose few of them."""
    rng = np.random.default_rng(12)
    stock = ["".join(rng.choice(list("abcdefghijklmnopqrstuvwxyz"), rng.integers(3, 9))) for _ in range(3000)]
    rows = []
    while len(rows) < 800:
        words = [str(w) for w in rng.choice(stock, rng.integers(5, 60))]
        other = list(words)
        for at in rng.choice(len(words), max(1, int(len(words) * rng.uniform(0, 0.2))), replace=False):
            other[at] = str(rng.choice(stock)) if len(rows) % 4 else "q" + other[at][1:]
        a, b = " ".join(words), " ".join(other)
        if a != b and lines.edit_similar(a.encode(), b.encode()):
            rows += [(len(rows), a), (len(rows) + 1, b)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    removed = {r.doc_id for r in lines.removed_lines(docs).collect()}
    assert removed <= set(range(1, 800, 2)) and len(removed) >= 0.97 * 400


def test_short_lines_are_linked_if_equal(spark):
    rows = [(1, "Read more\nalpha"), (2, "read MORE!\n \n--\nbeta"), (3, "Read mores\n東京都は日本の首都です\n--"), (4, "東京都は日本の首都です\nRead more")]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    got = {r.doc_id: r.text for r in lines.dedup_lines(docs).collect()}
    assert got == {1: rows[0][1], 2: " \n--\nbeta", 3: rows[2][1], 4: ""}


def test_pairs_compared_where_they_meet_or_moved(spark, monkeypatch):
    """A family of lines about the bound, in small cells: the same lines go whether pairs are moved or compared in their cells."""
    from marketloom.llm import blocks

    rng = np.random.default_rng(17)
    rows = []
    for family, changed in ((60, 3), (40, 4), (30, 1)):
        base = [f"word{x}" for x in rng.integers(0, 10**6, 18)]
        for _ in range(family):
            words = list(base)
            for at in rng.choice(18, changed, replace=False):
                words[at] = f"other{rng.integers(0, 10**6)}"
            rows.append((len(rows), "own line " + str(rng.integers(0, 10**9)) + "\n" + " ".join(words)))
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    monkeypatch.setattr(blocks, "BUCKET_ROWS", 16)
    monkeypatch.setattr(blocks, "SAMPLED", 1)
    there = {r.doc_id: r.removed for r in lines.removed_lines(docs).collect()}
    real = lines.linked
    monkeypatch.setattr(lines, "linked", lambda *a, short: real(*a))
    moved = {r.doc_id: r.removed for r in lines.removed_lines(docs).collect()}
    assert there == moved and 30 < len(there) < 130


def test_last_pairs_move_in_proportion(spark, monkeypatch):
    """Of lines that share a bucket by common words alone, only those go with their bodies that are near another in code and size."""
    from marketloom.llm import blocks

    rng = np.random.default_rng(21)
    rows = []
    for k in range(60):
        base = ["alpha", "bravo", "charlie", "delta"] * 5 + [f"w{x}" for x in rng.integers(10**5, 10**6, int(rng.integers(8, 40)))]
        if k < 5:  # of a size that no other line comes near
            base = [w + "x" * 20 * 3**k if w[0] == "w" else w for w in base]
        rng.shuffle(base)
        rows.append((k, " ".join(base)))
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    table = lines.line_table(docs)
    assert {r.size for r in table.select("size").collect()} == {len(b" ".join(lines.normalised(t)[0])) for _, t in rows}
    seen = []
    met = blocks._met

    def counted(signed, doubtful, group_of, bodies, similar, max_bits):
        member, several = blocks._several(signed, doubtful, group_of)
        every = member.join(several, "bucket").select("node").distinct().count()

        def asked(nodes):
            seen.append((nodes.distinct().count(), every))
            return bodies(nodes)

        return met(signed, doubtful, group_of, asked, similar, max_bits)

    monkeypatch.setattr(blocks, "_met", counted)
    monkeypatch.setattr(blocks, "_other_pairs", None)  # lines have no second forest
    removed = {(r.doc_id, n) for r in lines.removed_lines(docs).collect() for n in r.removed}
    assert removed == {(k, n) for (k, _), ns in plain(rows).items() for n in ns}
    assert seen and all(asked < every for asked, every in seen), seen
