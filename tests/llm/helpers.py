import re

TO_LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def alnum_words(text):
    return re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", (text or "").translate(TO_LOWER))


def frame(spark, rows, clash="row int, text_hash string, kept string, host string, n_words int"):
    """Documents from (doc_id, text, source, lang), with further columns of clashing names."""
    extra = [None] * len(clash.split(", "))
    return spark.createDataFrame([(*r, *extra) for r in rows], f"doc_id long, text string, source string, lang string, {clash}")


def thue_morse(doublings):
    """Two texts of a and b, each the other with the letters swapped: sums of powers of an odd base modulo 2 ** 64 cannot tell them apart."""
    swap = str.maketrans("ab", "ba")
    text = "a"
    for _ in range(doublings):
        text += text.translate(swap)
    return text, text.translate(swap)
