"""Page breaks against a plain fold over blocks, one page and one block after the other."""

import random

from inkwell.operators import pagination

random.seed(8)


def plain(blocks, height):
    """blocks: (ord, kind, gap, sizes, header); {page: [(block, part)]}."""
    page, used, out, last, placed = 1, 0, {}, None, False

    def put(block, part, h):
        nonlocal used
        out.setdefault(page, []).append((block, part))
        used += h

    def turn():
        nonlocal page, used
        page, used = page + 1, 0

    def start(b):
        _, kind, _, sizes, header = b
        if kind == "text":
            return sum(sizes[:2])
        if kind == "table":
            return min(sum(sizes) + header, header + sizes[0] if header else sum(sizes[:2]))
        return sum(sizes) if kind != "break" else 0

    i = 0
    while i < len(blocks):
        order, kind, gap, sizes, header = blocks[i]
        following = blocks[i + 1] if i + 1 < len(blocks) else None
        if kind == "break":
            if placed:
                turn()
            last, i = None, i + 1
            continue
        placed = True
        if last is not None and used > 0 and used + min(gap, pagination.GAP) <= height:
            used += min(gap, pagination.GAP)
        last = i
        if kind == "text":
            at, whole = 0, True
            while at < len(sizes):
                fit = 0
                while at + fit < len(sizes) and used + sum(sizes[at : at + fit + 1]) <= height:
                    fit += 1
                if whole and used > 0:
                    if len(sizes) - fit == 1 and fit > 1:
                        fit -= 1
                    if fit == 1 and len(sizes) > 1:
                        fit = 0
                elif whole and fit < len(sizes):
                    if len(sizes) - fit == 1 and fit > 1:
                        fit -= 1
                if fit == 0 and used > 0:
                    turn()
                    whole = False
                    continue
                for k in range(max(fit, 1)):
                    put(order, at + k, sizes[at + k])
                at += max(fit, 1)
                whole = False
                if at < len(sizes):
                    turn()
        elif kind == "table":
            part = 0
            if header:
                put(order, 0, header)
                part = 1
            for h in sizes:
                if used > 0 and used + h > height:
                    turn()
                    used = header if part else 0
                put(order, part, h)
                part += 1
        elif kind == "figure" and following and following[1] == "caption":
            if used > 0 and used + sizes[0] + following[3][0] > height:
                turn()
            for b in (blocks[i], following):
                if used > 0 and used + b[3][0] > height:
                    turn()
                put(b[0], 0, b[3][0])
            i += 1
            last = i
        else:
            need = sizes[0] + (start(following) if kind == "heading" and following else 0)
            if used > 0 and used + need > height:
                turn()
            put(order, 0, sizes[0])
        i += 1
    return out


def blocks(n, most):
    out = []
    for i in range(n):
        kind = random.choice(["text"] * 5 + ["heading", "figure", "caption", "table", "code", "break"])
        size = random.randint(1, 9)
        sizes = [random.randint(1, 2) for _ in range(size)] if kind in ("text", "table") else [random.randint(1, most)]
        header = random.choice([0, 1, 2]) if kind == "table" else 0
        out.append((i * 3 + 1, kind, random.choice([0, 1, 1, 3]), sizes, header))
    return out


def pages(spark, docs, height):
    rows = [(d, *b) for d, x in docs.items() for b in x]
    df = spark.createDataFrame(rows, "doc_id long, ord long, kind string, gap int, sizes array<int>, header int")
    out = {d: {} for d in docs}
    for r in pagination.pages(df, height).collect():
        out[r.doc_id][r.page] = ((r.first_block, r.first_part), (r.last_block, r.last_part), r.n_parts)
    return out


def test_against_a_fold(spark):
    for height in (7, 24):
        docs = {d: blocks(random.randint(1, 40), 6) for d in range(60)}
        docs[60] = blocks(400, 6)
        got = pages(spark, docs, height)
        for d, x in docs.items():
            want = {p: (parts[0], parts[-1], len(parts)) for p, parts in plain(x, height).items()}
            assert got[d] == want, (height, x)


def test_cases(spark):
    text = lambda o, n, gap=0: (o, "text", gap, [1] * n, 0)
    docs = {
        1: [text(1, 3)],
        2: [text(1, 9), text(2, 2)],  # the second text's first line alone would fit
        3: [text(1, 8), text(2, 3)],  # two lines would leave one behind
        4: [(1, "heading", 0, [1], 0), text(2, 25)],
        5: [text(1, 8), (2, "heading", 0, [1], 0), text(3, 5)],
        6: [(1, "break", 0, [1], 0), text(2, 1), (3, "break", 0, [1], 0), (4, "break", 0, [1], 0), text(5, 1)],
        7: [(1, "table", 0, [1] * 20, 2)],
        8: [text(1, 6), (2, "figure", 1, [3], 0), (3, "caption", 5, [1], 0)],
        9: [(1, "code", 0, [30], 0), text(2, 1)],
        10: [(1, "break", 0, [1], 0)],
    }
    got = {d: [n for _, (*_, n) in sorted(x.items())] for d, x in pages(spark, docs, 10).items()}
    assert got == {1: [3], 2: [9, 2], 3: [8, 3], 4: [10, 10, 6], 5: [8, 6], 6: [1, 1], 7: [9, 8, 4], 8: [6, 2], 9: [1, 1], 10: []}
    assert sorted(pages(spark, {6: docs[6]}, 10)[6]) == [1, 3]


def test_empty_table(spark):
    df = spark.createDataFrame([], "doc_id long, ord long, kind string, gap int, sizes array<int>, header int")
    assert pagination.pages(df, 10).collect() == []


def test_pieces_are_placed_in_one_go(spark):
    """Two long documents in batches of a few pieces; a page looks neither at all pieces ahead nor up pages by joins."""
    rows = [(d, k, "break" if k % 50 == 0 and d else "text", 1, [1] * (k % 7 + 1), 0) for d in range(2) for k in range(400)]
    docs = spark.createDataFrame(rows, "doc_id long, ord long, kind string, gap int, sizes array<int>, header int")
    before = spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch")
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "7")
    try:
        made = pagination.pages(docs, 10)
        plan = made._jdf.queryExecution().toString()
        assert "collect_list" not in plan and "Join" not in plan
        found = {}
        for r in made.collect():
            found[r["doc_id"], r["page"]] = tuple(r)[2:]
    finally:
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", before)
    for d in range(2):
        want = plain([tuple(r[1:]) for r in rows if r[0] == d], 10)
        assert {p: x for (k, p), x in found.items() if k == d} == {p: (*v[0], *v[-1], len(v)) for p, v in want.items()}
