from lattica.llm import chat

SCHEMA = "conv_id long, turn long, role string, text string, chunk int, pos string"


def brute(rows):
    convs = {}
    for c, t, r, x in set(rows):
        convs.setdefault(c, []).append(((t is not None, t or 0), r or "", x or "", t))
    content = {c: tuple((r, x) for _, r, x, _ in sorted(v, key=lambda k: k[:3])) for c, v in convs.items()}
    keep = {}
    for c, v in content.items():
        if not any(len(o) > len(v) and o[: len(v)] == v for o in content.values()):
            same = [k for k, o in content.items() if o == v]
            keep[min((k for k in same if k is not None), default=None)] = v
    return {c: "".join(f"<|im_start|>{r}\n{x}<|im_end|>\n" for r, x in v) for c, v in keep.items()}


def rendered(df):
    out = {}
    for r in sorted(df.collect(), key=lambda r: r["part"]):
        out[r["conv_id"]] = out.get(r["conv_id"], "") + r["chat"]
    return out


def test_matches_brute_force(spark):
    rows = []
    base = [("user", f"q{i}") if i % 2 == 0 else ("assistant", f"a{i}") for i in range(12)]
    for c, n in enumerate([1, 2, 3, 5, 12, 12, 4]):
        rows += [(c, t, *base[t]) for t in range(n)]
    rows += [(20, t, *base[t]) for t in range(3)] + [(20, 3, "user", "other way")]
    rows += [(21, 0, None, None), (22, 0, "", ""), (23, None, "user", "first"), (23, 5, "user", "x"), (23, 5, "user", "x"), (None, 0, "user", "lost"), (24, 0, "user", "y" * 50000)]
    rows += [(30, t, "user", f"t{t}") for t in range(2500)] + [(31, t, "user", f"t{t}") for t in range(1500)]
    df = spark.createDataFrame([(*r, 1, "p") for r in rows], SCHEMA).repartition(5)
    assert rendered(chat.collapse_and_render(df)) == brute(rows)
    assert chat.collapse_and_render(df.limit(0)).collect() == []


def test_many_share_first_turn(spark):
    rows = [(c, 0, "user", "hello") for c in range(300)] + [(c, 1, "assistant", f"r{c % 150}") for c in range(0, 300, 2)]
    got = rendered(chat.collapse_and_render(spark.createDataFrame([(*r, 1, "p") for r in rows], SCHEMA)))
    assert got == brute(rows)
