"""Each operator against plain Python on small tables with NULLs, empty texts, ties, repeated rows and clashing columns."""

import collections
import hashlib
import math
import random
import re
import zlib

import pytest

from tidemark.llm.fingerprints import imatch
from tidemark.llm.html_extract import extract
from tidemark.llm.jaccard_join import near_duplicates
from tidemark.llm.mixing import mix_sources
from tidemark.llm.mixing_lm import score
from tidemark.llm.packing import pack, pack_histogram
from tidemark.llm.quality import judge
from tidemark.llm.queries import URL_RULES, tokenizer_path
from tidemark.llm.substring_dedup import dedup
from tidemark.llm.suffix_dedup import remove_repeats
from tidemark.llm.url_rules import fixed_rules, judge_urls

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, word string, bucket int, id string"


def made_texts():
    rng = random.Random(5)
    words = ["".join(rng.choice("abcdeé") for _ in range(rng.randint(1, 6))) for _ in range(300)]
    prose = lambda n: " ".join(rng.choice(words) for _ in range(n))
    base, passage = prose(120), prose(90)
    texts = [None, "", "  \n\t", "one", "one", "Two words", "x " * 60, base, base, base.upper().replace("É", "é")]
    for _ in range(12):
        w = base.split()
        for i in rng.sample(range(len(w)), rng.randint(1, 6)):
            w[i] = "edit"
        texts.append(" ".join(w))
    texts += [f"{prose(rng.randint(5, 60))}\n{passage}\n{prose(rng.randint(5, 60))}" for _ in range(8)]
    texts += [prose(rng.randint(1, 400)) for _ in range(25)] + [prose(9000), "a b c d e " * 500, "# $ % & | " * 40]
    return texts


TEXTS = made_texts()


@pytest.fixture(scope="module")
def docs(spark):
    rows = [(3 * i, t, "en" if i % 3 else None, f"s{i % 4}" if i % 9 else None, len(t or ""), "w", 1, "z") for i, t in enumerate(TEXTS)]
    return spark.createDataFrame(rows, SCHEMA).repartition(5)


@pytest.fixture(scope="module")
def empty(spark):
    return spark.createDataFrame([], SCHEMA)


def words_of(text):
    return re.findall(r"[^\x20\x09-\x0D]+", text or "")


def low(text):
    return (text or "").encode().lower().decode()


def test_near_duplicates(docs, empty):
    sets = {}
    for i, t in enumerate(TEXTS):
        w = words_of(low(t))
        sets[3 * i] = {tuple(w[j:j + 5]) for j in range(len(w) - 4)} if len(w) >= 5 else ({tuple(w)} if w else set())
    label = {k: k for k in sets}
    for _ in sets:
        for a in sets:
            for b in sets:
                if sets[a] and sets[b] and 100 * len(sets[a] & sets[b]) >= 75 * len(sets[a] | sets[b]):
                    label[a] = label[b] = min(label[a], label[b])
    got = {r.doc_id: (r.n_shingles, r.component_id) for r in near_duplicates(docs).collect()}
    assert got == {k: (len(s), label[k]) for k, s in sets.items()}
    assert near_duplicates(empty).count() == 0


def test_near_duplicates_in_a_crowd(spark):
    """More sets share signatures than are compared in pairs."""
    rng = random.Random(1)
    base = [f"w{i}" for i in range(150)]
    rows = []
    for i in range(90):
        w = list(base)
        for j in rng.sample(range(150), rng.randint(0, 12)):
            w[j] = f"e{i}_{j}"
        rows.append((i, " ".join(w)))
    sets = [{tuple(t.split()[j:j + 5]) for j in range(146)} for _, t in rows]
    label = list(range(90))
    for _ in range(90):
        for a in range(90):
            for b in range(a):
                if 100 * len(sets[a] & sets[b]) >= 75 * len(sets[a] | sets[b]):
                    label[a] = label[b] = min(label[a], label[b])
    got = {r.doc_id: r.component_id for r in near_duplicates(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert got == dict(enumerate(label))


def test_fingerprints(docs, empty):
    got = {r.doc_id: r for r in imatch(docs).collect()}
    for i, t in enumerate(TEXTS):
        t, following = t or "", TEXTS[(i + 1) % len(TEXTS)] or ""
        edited = t[: len(t) - len(t) // 2] + following[: len(t) // 2]
        r = got[3 * i]
        assert (r.n_chars, r.edited_sha256) == (len(t), hashlib.sha256(edited.encode()).hexdigest())
        assert 0 <= r.near_edited <= 1 and 0 <= r.near_next <= 1
    assert got[21].fingerprint == got[24].fingerprint and got[21].near_next == 1.0
    assert imatch(empty).count() == 0


def test_quality(docs, empty):
    got = {r.doc_id: r for r in judge(docs).collect()}
    for i, t in enumerate(TEXTS):
        w = words_of(t)
        n = collections.Counter(tuple(w[j:j + 5]) for j in range(len(w) - 4))
        again = {j + k for j in range(len(w) - 4) if n[tuple(w[j:j + 5])] > 1 for k in range(5)}
        lines = [x for x in (t or "").split("\n") if words_of(x)]
        r = got[3 * i]
        assert (r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words) == (
            len(w), sum(map(len, w)), len(re.findall(r"[#*$%&|<>]", t or "")), len(lines) - len(set(lines)), len(again))
        assert r.base_failed == (len(w) < 10 or 100 * len(again) > 20 * len(w)) and not (r.base_failed and r.kept)
    assert judge(empty).count() == 0


def test_byte_repeats(docs, empty):
    data = {3 * i: (t or "").encode() for i, t in enumerate(TEXTS)}
    seen = collections.Counter(b[i:i + 400] for b in data.values() for i in range(len(b) - 399))
    got = {r.doc_id: r for r in remove_repeats(docs).collect()}
    for k, b in data.items():
        cut = bytearray(len(b))
        for i in range(len(b) - 399):
            if seen[b[i:i + 400]] > 1:
                cut[i:i + 400] = b"\1" * 400
        kept = bytes(x for x, c in zip(b, cut) if not c)
        assert (got[k].n_bytes, got[k].n_removed, bytes(got[k].kept)) == (len(b), sum(cut), kept)
        assert got[k].n_spans == len(re.findall(b"\1+", bytes(cut)))
    assert remove_repeats(empty).count() == 0


def test_word_repeats(docs, empty):
    seen, got = set(), {r.doc_id: r for r in dedup(docs).collect()}
    for i, t in enumerate(TEXTS):
        w = words_of(t)
        cut = [False] * len(w)
        for j in range(len(w) - 19):
            if tuple(w[j:j + 20]) in seen:
                cut[j:j + 20] = [True] * 20
            seen.add(tuple(w[j:j + 20]))
        r = got[3 * i]
        assert (r.n_words, r.n_removed, r.kept_text) == (len(w), sum(cut), " ".join(x for x, c in zip(w, cut) if not c))
    assert dedup(empty).count() == 0


def test_packing(docs, empty):
    from tokenizers import Tokenizer

    tokenizer = Tokenizer.from_file(tokenizer_path())
    rows = pack(docs, tokenizer_path()).collect()
    packs, lengths = collections.defaultdict(list), collections.Counter()
    for r in rows:
        ids = [*tokenizer.encode(TEXTS[r.doc_id // 3] or "", add_special_tokens=False).ids, 2]
        part = b"".join(x.to_bytes(4, "little") for x in ids[r.start:r.start + r.length])
        assert (r.doc_tokens, r.ids_crc32) == (len(ids), zlib.crc32(part))
        packs[r.sequence_id].append((r.offset, r.length))
        lengths[r.doc_id] += r.length
    assert lengths == {r.doc_id: r.doc_tokens for r in rows} and len(lengths) == len(TEXTS)
    for p in packs.values():
        at = 0
        for offset, length in sorted(p):
            assert offset == at
            at += length
        assert at <= 4096
    assert pack(empty, tokenizer_path()).count() == 0


def test_pack_histogram_places_all():
    rng = random.Random(2)
    counts = {rng.randint(1, 50): rng.randint(1, 9) for _ in range(30)}
    placed = collections.Counter()
    for number, lengths in pack_histogram(counts, 50):
        assert sum(lengths) <= 50
        placed.update({x: number * n for x, n in collections.Counter(lengths).items()})
    assert placed == counts


def test_urls(spark):
    urls = [None, "", "no scheme", "http://A.net", "http://a.NET/x?y", "https://example.net/en/1", "https://q.example.net/en", "http://example.com/de/",
            "http://badexample.com/de/", "http://x.org/fr/#z", "http://org/fr/a/b/c", "http://org/en", "a://b://c.net/d", "http://a.net/x?y"]
    rows = [(i, u, "h") for i, u in enumerate(urls)] + [(13, urls[13], "h"), (None, "http://b.net/", "h")]
    got = sorted(((r.page_id, r.host, r.path, r.rule, r.verdict) for r in judge_urls(
        spark.createDataFrame(rows, "page_id long, url string, host string"), fixed_rules(spark, URL_RULES)).collect()), key=str)
    want = []
    for i, u, _ in rows:
        rest = (u or "").split("://", 1)[1] if "://" in (u or "") else ""
        host = low(re.match("[^/?#]*", rest)[0])
        path = re.match("[^?#]*", rest[len(host):])[0]
        fits = [(len(h + p), h + p, v) for h, p, v in URL_RULES if (host == h or host.endswith("." + h)) and path.startswith(p)]
        _, rule, verdict = max(fits, default=(0, None, "allow"))
        want.append((i, host, path, rule, verdict))
    assert got == sorted(want, key=str)


PAGE = ('<html><head><title>T</title><script>var a="</p>"</script></head><body><div>Site name</div><nav><a href="/">Home</a></nav><div class="ad">Buy</div>'
        "{0}<footer>&copy; x</footer></body></html>")


def test_html(spark):
    article = "<article><h1>Head {0}</h1><p><b>One  &amp; {0}<br><p>Two\n{0}</p><div class='comments'><p>me too</p></div></article>"
    plain = "<div><p>Long text about number {0} only.</p></div>"
    rows = [(i, f"http://a.com/{i}", PAGE.format(article.format(i))) for i in range(5)] + [(10 + i, f"http://b.com/{i}", PAGE.format(plain.format(i))) for i in range(5)]
    rows += [(20, None, None), (21, "x", ""), (22, "http://c.com/", "<article><p>Cut &am"), (None, "http://a.com/0", rows[0][2])]
    got = extract(spark.createDataFrame(rows, "page_id long, url string, html string")).collect()
    texts = {r.page_id: r.text for r in got}
    assert len(got) == len(rows) and all(r.n_chars == len(r.text) for r in got)
    assert all(texts[i] == f"Head {i}\nOne & {i}\nTwo {i}" for i in range(5))
    assert all(texts[10 + i] == f"Long text about number {i} only." for i in range(5))  # "Site name" is template
    assert (texts[20], texts[21], texts[22], texts[None]) == ("", "", "Cut &am", texts[0])


def test_language_model(docs, empty):
    tokens = {3 * i: [*words_of(low(t)), None] for i, t in enumerate(TEXTS)}
    held = {k: zlib.crc32(str(k).encode()) % 10 == 0 for k in tokens}
    c = collections.Counter(w for k, ws in tokens.items() if not held[k] for w in ws)
    total = sum(c.values())
    for r in score(docs).collect():
        ws = tokens[r.doc_id]
        base = sum(math.log10((c[w] + 0.1) / (total + 0.1 * (len(c) + 1))) for w in ws)
        assert (r.held_out, r.n_tokens, r.n_known, r.train_tokens) == (held[r.doc_id], len(ws), sum(c[w] > 0 for w in ws), total)
        assert r.base_score == pytest.approx(base, abs=1e-6) and r.score < 0
    assert score(empty).count() == 0


def test_mixing(docs, empty):
    got = {r.doc_id: r for r in mix_sources(docs).collect()}
    sizes, source = {3 * i: len(words_of(t)) for i, t in enumerate(TEXTS)}, {3 * i: f"s{i % 4}" if i % 9 else None for i in range(len(TEXTS))}
    names = sorted({s for s in source.values() if s}) + [None]
    total = {s: sum(n for k, n in sizes.items() if source[k] == s) for s in names}
    weight, fixed = {s: (5, 2, 1)[i % 3] for i, s in enumerate(names)}, {}
    while True:
        rest, free = sum(total.values()) - sum(fixed.values()), [s for s in names if s not in fixed]
        level = rest / sum(weight[s] for s in free)
        over = [s for s in free if level * weight[s] > 3 * total[s]]
        if not over:
            break
        fixed |= {s: 3 * total[s] for s in over}
    for s in names:
        rows = [r for k, r in got.items() if source[k] == s]
        target = fixed.get(s, level * weight[s])
        assert all(r.target == pytest.approx(target) and r.source_size == total[s] and r.size == sizes[r.doc_id] and 0 <= r.taken <= 3 * r.size for r in rows)
        assert abs(sum(r.taken for r in rows) - target) <= 1
    assert {k: r.taken for k, r in got.items()} == {r.doc_id: r.taken for r in mix_sources(docs.repartition(3)).collect()}
    assert mix_sources(empty).count() == 0
