import random

from watchgrid.llm.chat import best_paths, chains, digests, escape, format_conversations, read_back, render, unescape

ODD = ["", "\\", "\\\\<|", "</s>[INST] ok [/INST]", "<|im_end|>", "<<SYS>>", "<</sys>>", "<<|im_start|>", "a < b [c] \\n", "<\\/s>", "\\</s>\\", "é🙂\n\r"]


def test_escaping_is_reversible_and_leaves_no_control_string():
    rng = random.Random(4)
    bits = ["<", ">", "|", "\\", "/", "s>", "[", "INST]", "[/INST]", "SYS>>", "im_end", "x", "<|", "eos>"]
    texts = ODD + ["".join(rng.choice(bits) for _ in range(rng.randrange(12))) for _ in range(3000)]
    for text in texts:
        made = escape(text)
        assert unescape(made) == text
        assert not any(c in made.lower() for c in ("<|", "<s>", "</s>", "[inst]", "[/inst]", "<<sys>>", "<</sys>>", "<eos>"))
    turns = [(t, u) for t, u in zip(texts[:200], texts[200:400])]
    assert read_back(render(turns)[0]) == turns


def test_conversations_round_trip(spark):
    rng = random.Random(8)
    talks = {c: [(t, rng.choice(["user", "assistant", "system", None, "a\nb"]), rng.choice([*ODD, None])) for t in range(n)] for c, n in {1: 1, 2: 2, 3: 9, 4: 70, None: 3}.items()}
    rows = [(c, 10 * t, r, x, 0) for c, turns in talks.items() for t, r, x in turns]
    rng.shuffle(rows)
    nodes = chains(spark.createDataFrame(rows, "conv_id long, turn int, role string, text string, node int"))
    got = {r.tree: r for r in format_conversations(nodes).collect()}
    assert got.keys() == talks.keys()
    for c, turns in talks.items():
        said = [(r or "", x or "") for _, r, x in turns]
        assert read_back(got[c].formatted) == said
        spans = list(zip(got[c].loss_mask[::2], got[c].loss_mask[1::2]))
        assert [unescape(got[c].formatted[a:b]) for a, b in spans] == [x for r, x in said if r == "assistant"]
    read = {r.conv_id: r for r in digests(format_conversations(nodes)).collect()}
    assert all(read[c].n_turns == len(t) and read[c].formatted_chars == len(got[c].formatted) for c, t in talks.items())
    assert format_conversations(nodes.limit(0)).count() == 0


def test_branches_against_brute_force(spark):
    rng = random.Random(9)
    rows = []
    for tree in range(6):
        for node in range(40):
            rows.append((tree, node, rng.randrange(node) if node else None, float(rng.randrange(5)), "user", str(node)))
    rows += [(7, 1, 2, 1.0, "user", "circle"), (7, 2, 1, 1.0, "user", "circle"), (8, 5, 99, 1.0, "user", "orphan")]
    nodes = spark.createDataFrame(rows, "tree long, node long, parent long, score double, role string, text string")
    want = {}
    for tree in [*range(6), 8]:
        own = {r[1]: r for r in rows if r[0] == tree}
        paths = []
        for leaf in own.keys() - {r[2] for r in own.values()}:
            path = [leaf]
            while (p := own[path[-1]][2]) in own:
                path.append(p)
            paths.append((-sum(own[n][3] for n in path), -len(path), leaf, path[::-1]))
        want |= {(tree, i + 1): p[3] for i, p in enumerate(sorted(paths)[:3])}
    got = {}
    for r in sorted(best_paths(nodes, 3).collect(), key=lambda r: r.depth):
        got.setdefault((r.tree, r.branch), []).append(r.node)
    assert got == want
