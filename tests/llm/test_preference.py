import random

from foldsmith.llm import preference


def brute(pairs, turns):
    conv = {}
    for c, turn, role, text in turns:
        conv.setdefault(c, []).append((turn is not None, turn or 0, role or "unknown", text or ""))
    out = []
    for a, b in pairs:
        if a not in conv or b not in conv:
            continue
        x, y = ([t[2:] for t in sorted(conv[c])] for c in (a, b))
        n = 0
        while n < min(len(x), len(y)) and x[n] == y[n]:
            n += 1

        def say(ts):
            s, spans = "", []
            for role, text in ts:
                s += f"<|{role}|>\n"
                if role == "assistant":
                    spans.append((len(s), len(s) + len(text)))
                s += text + "\n"
            return s, spans

        (cs, cl), (rs, rl) = say(x[n:]), say(y[n:])
        out.append((a, b, n, say(x[:n])[0], cs, rs, cl, rl))
    return sorted(map(str, out))


def test_against_brute_force(spark):
    rnd = random.Random(9)
    turns = []
    for c in range(60):
        first = [rnd.choice(["hi", "Ünï 🙂", ""]) for _ in range(rnd.randint(1, 6))]
        for k, t in enumerate(first):
            turns.append((c, k, ["user", "assistant"][k % 2], t))
    turns += [(70, None, None, None), (71, None, None, None), (70, 1, "assistant", None), (71, 1, "assistant", "x"), (None, 0, "user", "a"), (72, 0, "user", "alone"), (0, 0, "user", "hi"), (80, 0, "assistant", "y" * 9000), (81, 0, "system", "")]
    df = spark.createDataFrame([(*t, 1) for t in turns], "conv_id long, turn long, role string, text string, prompt int")
    pairs = [(c, c + 1) for c in range(0, 100, 2) if c != 72]
    got = preference.format_pairs(preference.neighbour_pairs(df), df).collect()
    mine = sorted(str((r.chosen_id, r.rejected_id, r.n_common, r.prompt, r.chosen, r.rejected, [tuple(s) for s in r.chosen_loss], [tuple(s) for s in r.rejected_loss])) for r in got)
    assert mine == brute(pairs, turns)
    assert preference.format_pairs(preference.neighbour_pairs(df.limit(0)), df.limit(0)).collect() == []
