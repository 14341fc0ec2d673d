import re
from collections import Counter, defaultdict

from helpers import TO_LOWER, frame, thue_morse

from panelwright.llm.quality import filter_quality, quality


def plain(rows, max_share, min_docs, min_left):
    """The rules, written out, for (doc_id, text, host)."""
    def lines(text):
        return [(p, re.findall(r"[^\x20\x09-\x0D]+", line), line) for p, line in enumerate((text or "").split("\n"))]

    texts, seen = defaultdict(set), defaultdict(set)
    for _, text, host in rows:
        texts[host or ""].add(text)
        for _, words, _ in lines(text):
            if words:
                seen[host or "", " ".join(words).translate(TO_LOWER)].add(text)
    out = []
    for doc, text, host in rows:
        words = re.findall(r"[^\x20\x09-\x0D]+", text or "")
        wins = Counter(tuple(words[i : i + 8]) for i in range(len(words) - 7))
        hit = {i + k for i in range(len(words) - 7) if wins[tuple(words[i : i + 8])] > 1 for k in range(8)}
        full = [line for _, w, line in lines(text) if w]
        gone = [(p, len(w)) for p, w, _ in lines(text) if w and min_docs < (n := len(seen[host or "", " ".join(w).translate(TO_LOWER)])) and n > max_share * len(texts[host or ""])]
        failed = len(words) < 20 or 100 * len(hit) > 30 * len(words)
        left = len(words) - sum(n for _, n in gone)
        out.append((doc, len(words), sum(map(len, words)), len(re.findall(r"[#*$%&|<>]", text or "")), len(full) - len(set(full)), len(hit), failed, [p for p, _ in gone], left, not failed and left >= min_left * len(words)))
    return sorted(out, key=str)


def rows_of(docs, **limits):
    return sorted(((r.doc_id, r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words, r.base_failed, r.removed_lines, r.words_left, r.kept) for r in quality(docs, **limits).collect()), key=str)


def sample():
    menu = "Home About Contact"
    rows = [(k, f"{menu}\n" + " ".join(f"wörd{k}x{i}" for i in range(30)), "a", "en") for k in range(8)]
    rows += [(10 + k, f" home  ABOUT contact \n{' '.join(f'w{k}{i}' for i in range(25))}\n\n{menu}", "a", "en") for k in range(3)]
    rows += [(20, "\n".join([menu] * 9), "a", "en"), (21, "same words again and again here now " * 12, "b", "en"), (22, None, None, None), (23, "", "b", "en"), (24, "a | b # c\nx\nx\n y", "b", "fr")]
    rows += [(30, f"{menu}\n" + "copy " + " ".join(f"c{i}" for i in range(30)), "b", "en")] * 9 + [(None, "word " * 200_000, "a", "en")]
    return rows


def test_against_brute_force(spark):
    rows = sample()
    assert rows_of(frame(spark, rows), max_share=0.1, min_docs=4) == plain([r[:3] for r in rows], 0.1, 4, 1 / 3)
    kept = {r[0]: (r[-1], r[-2]) for r in rows_of(frame(spark, rows), max_share=0.1, min_docs=4)}
    assert kept[20] == (False, 0), "nothing is left of a document of menu lines"
    assert kept[30] == (True, 34), "copies of one text are one text"


def test_filter_removes_lines_and_documents(spark):
    out = {r.doc_id: r for r in filter_quality(frame(spark, sample()).withColumn("n_chars", __import__("pyspark").sql.functions.lit(7)), max_share=0.1, min_docs=4).collect()}
    assert set(out) == {*range(8), 10, 11, 12, 30}
    assert out[10].text == " ".join(f"w0{i}" for i in range(25)) + "\n" and out[10].n_chars == len(out[10].text)


def test_empty(spark):
    assert quality(frame(spark, [])).collect() == [] and filter_quality(frame(spark, [])).collect() == []


def test_lines_and_windows_of_one_form_are_told_apart(spark):
    one, two = thue_morse(11)
    lines = [(1, f"{one}\n{two}\n{one} {two}\n{two} {one}", "h", "en"), (2, " ".join([*"abcdefg", one, *"abcdefg", two]), "h", "en")]
    assert rows_of(frame(spark, lines), max_share=0.02, min_docs=10, min_left=1 / 3) == plain([r[:3] for r in lines], 0.02, 10, 1 / 3)
