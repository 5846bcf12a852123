import random

import pytest

from faultloom.llm.packing import VOCABULARY, Limits, Packer, encoder, packed_containers, pieces, prompt_tokens

SCHEMA = "doc_id long, text string, n_tokens string, container_id string"


def test_packer_respects_all_limits_and_wastes_little():
    rng = random.Random(2)
    p = Packer(Limits(1000, 12, 700))
    n = 3000
    for i in range(n):
        t = rng.choice([rng.randrange(1, 60), rng.randrange(60, 1001)])
        p.add(t, min(700, rng.randrange(t + 1)), i)
    total, seen, used = p.tokens, set(), []
    while p.sizes:
        content, tokens, why = p.fill()
        assert why in ("tokens", "segments", "loss", "end")
        assert content and tokens == sum(c[0] for c in content) <= 1000 and len(content) <= 12 and sum(c[1] for c in content) <= 700
        seen |= {c[2] for c in content}
        used.append(tokens)
    assert len(seen) == n and p.tokens == 0 and len(used) < 1.1 * total / 1000


def test_pieces_cover_the_text_between_characters():
    enc = encoder(VOCABULARY)
    text = "日本語の長い文字列と😀絵文字、and words. " * 60
    cut = list(pieces(text, enc, 64))
    assert cut[0][0] == 0 and cut[-1][1] == len(text) and all(a[1] == b[0] for a, b in zip(cut, cut[1:])) and max(c[2] for c in cut) <= 64
    assert list(pieces("", enc, 64)) == [] and list(pieces("<|endoftext|>", enc, 64))[0][:2] == (0, 13)


@pytest.mark.parametrize("chunk", [24_000_000, 5_000])
def test_containers(spark, chunk):
    rng = random.Random(3)
    docs = [(i, " ".join(rng.choice(["alpha", "beta", "gamma", "δέλτα"]) for _ in range(rng.randrange(1, 400))), "x", "y") for i in range(300)]
    docs += [(1000, "long " * 5000, "x", "y"), (1001, None, "x", "y"), (1002, "", "x", "y"), (None, "no id", "x", "y"), (5, docs[5][1], "x", "y")]
    lim = Limits(512, 16, 512)
    rows = packed_containers(spark.createDataFrame(docs, SCHEMA), limits=lim, chunk_chars=chunk).collect()
    by, per = {}, {}
    for r in rows:
        by.setdefault(r.container_id, []).append(r)
        per.setdefault(r.doc_id, []).append(r)
    for c in by.values():
        assert sum(r.n_tokens for r in c) <= 512 and len(c) <= 16 and sorted(r.segment_no for r in c) == list(range(1, len(c) + 1))
    texts = {d[0]: d[1] for d in docs if d[1]}
    assert set(per) == set(texts) and len(per[5]) == 2
    long = sorted(per[1000], key=lambda r: r.start_char)
    assert "".join(r.text for r in long) == texts[1000] and len(long) > 1
    assert all("".join(r.text for r in sorted(rs, key=lambda r: r.start_char)) == texts[d] for d, rs in per.items() if d != 5)
    assert all(len(rs) == 1 for d, rs in per.items() if d not in (5, 1000) and sum(r.n_tokens for r in rs) <= 512)
    assert sum(r.n_tokens for r in rows) / (512 * len(by)) > 0.9
    assert packed_containers(spark.createDataFrame([], SCHEMA)).count() == 0


def test_prompt_is_the_first_of_several_paragraphs():
    enc = encoder(VOCABULARY)
    n = lambda t: len(enc.encode_ordinary(t))
    assert prompt_tokens("a b\nc\n \n\nd", enc) == n("a b\nc\n \n\n") and prompt_tokens("\n\n a\n\nb", enc) == n("\n\n a\n\n")
    assert prompt_tokens("a\nb", enc) == prompt_tokens("a\n\n \n", enc) == prompt_tokens(" \n\n", enc) == prompt_tokens("x" * 100_000 + " " * 100_000, enc) == 0


def test_the_choice_is_the_largest_dot_product():
    rng = random.Random(4)
    lim = Limits(300, 9, 200)
    p = Packer(lim)
    waiting = []
    for i in range(400):
        t = rng.randrange(1, 200)
        loss = rng.randrange(t + 1)
        p.add(t, loss, i)
        waiting.append((t, loss))
    for _ in range(300):
        rt, rl = rng.randrange(1, 300), rng.randrange(1, 200)
        dots = [t * rt / 300**2 + x * rl / 200**2 for t, x in waiting if t <= rt and x <= rl]
        got = p.choose(rt, 5, rl)
        if not dots:
            assert got is None
            continue
        size = p.sizes[got[0]]
        assert abs(size * rt / 300**2 + p.by_size[size][got[1]][0] * rl / 200**2 - max(dots)) < 1e-12


def test_each_limit_can_close_a_container(spark):
    docs = [(i, "a b c", "x", "y") for i in range(40)] + [(100 + i, "question here\n\n" + "answer " * 150, "x", "y") for i in range(30)] + [(200 + i, "prompt " * 300 + "\n\nshort", "x", "y") for i in range(30)] + [(300, "q\n\n" + "long " * 900, "x", "y")]
    lim = Limits(512, 10, 320)
    rows = packed_containers(spark.createDataFrame(docs, SCHEMA), limits=lim).collect()
    by = {}
    for r in rows:
        by.setdefault(r.container_id, []).append(r)
    for c in by.values():
        assert sum(r.n_tokens for r in c) <= 512 and len(c) <= 10 and sum(r.n_loss for r in c) <= 320 and len({r.closed_by for r in c}) == 1
    assert {c[0].closed_by for c in by.values()} >= {"tokens", "loss"} and all(r.n_loss <= r.n_tokens for r in rows)
    long = sorted((r for r in rows if r.doc_id == 300), key=lambda r: r.start_char)
    assert "".join(r.text for r in long) == docs[-1][1] and sum(r.n_tokens - r.n_loss for r in long) == len(encoder(VOCABULARY).encode_ordinary("q\n\n"))
