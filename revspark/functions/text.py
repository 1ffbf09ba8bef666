"""Text cleaning, sentence splitting and score post-processing as Column expressions."""
from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F

from . import constants as K
from .columns import col

# Python's str.isspace() set, spelled out so every engine uses the same class.
WS = (r"\t\n\x{0B}\f\r \x{1C}-\x{1F}\x{85}\x{A0}\x{1680}\x{2000}-\x{200A}"
      r"\x{2028}\x{2029}\x{202F}\x{205F}\x{3000}")
WS_CHARS = "\t\n\x0b\f\r \x1c\x1d\x1e\x1f\x85\xa0\u1680" + "".join(map(chr, range(0x2000, 0x200B))) + "\u2028\u2029\u202f\u205f\u3000"
HANGUL = "가-힣"
LATIN_TEST_CLASS = r"\p{L}\p{N}"
# fixed value: runs of laughing and crying letters
LAUGH_RUNS = "ㅋ{2,}|ㅎ{2,}|ㅠ{2,}|ㅜ{2,}"


def _lit_array(values: Sequence[str]) -> Column:
    return F.array(*[F.lit(v) for v in values]) if values else F.array().cast("array<string>")


def tokens(text) -> Column:
    """Whitespace tokens, empties dropped (Python's ``str.split()``)."""
    return F.filter(F.split(col(text), f"[{WS}]+"), lambda w: w != "")


def token_pattern(words: Sequence[str]) -> str | None:
    """A regex matching any of ``words`` as a whole whitespace-separated token.
    Entries containing whitespace can never equal a token, so they are left out."""
    ws = set(" \t\n\r\f\x0b\x1c\x1d\x1e\x1f\x85\xa0\u1680\u2028\u2029\u202f\u205f\u3000") | \
        {chr(c) for c in range(0x2000, 0x200B)}
    keep = sorted({w for w in words if w and not (set(w) & ws)}, key=lambda w: (-len(w), w))
    if not keep:
        return None
    alts = "|".join(r"\Q" + w + r"\E" for w in keep)
    return f"(?<=^|[{WS}])(?:{alts})(?=[{WS}]|$)"


def _drop_tokens(t: Column, stopwords: Sequence[str]) -> Column:
    """Remove stopword tokens, collapse whitespace runs to one space, strip: the
    same as split / filter / join, as three native regex passes (no per-token
    lambda)."""
    pat = token_pattern(stopwords)
    if pat:
        t = F.regexp_replace(t, pat, "")
    return F.trim(F.regexp_replace(t, f"[{WS}]+", " "))


def clean_text(text, *, stopwords: Sequence[str], keep: str = HANGUL) -> Column:
    """Drop laugh/cry runs, every char outside ``keep`` and whitespace, stopword
    tokens; collapse whitespace. NULL text becomes the string 'None' first."""
    t = F.coalesce(col(text).cast("string"), F.lit("None"))
    t = F.regexp_replace(t, LAUGH_RUNS, "")
    t = F.regexp_replace(t, f"[^{keep}{WS}]", "")
    return _drop_tokens(t, stopwords)


def remove_stopwords(text, stopwords: Sequence[str]) -> Column:
    return _drop_tokens(col(text), stopwords)


SENTENCE_END = r"[.!?。！？]+"


def split_sentences_punct(text) -> Column:
    """Rule-based sentence split on end punctuation of the raw text."""
    return F.split(F.coalesce(col(text), F.lit("")), SENTENCE_END)


def token_windows(text, window: int, single_spaced: bool = False) -> Column:
    """Consecutive runs of ``window`` whitespace-separated tokens, left to right
    (the last run may be shorter), each joined by single spaces. One regex scan
    of the text: linear in its length, whatever the number of windows. Text that is
    already single-spaced (cleaned text) skips the per-window normalisation."""
    t = F.coalesce(col(text), F.lit(""))
    if single_spaced:
        return F.regexp_extract_all(t, F.lit(rf"[^ ]+(?: [^ ]+){{0,{window - 1}}}"), 0)
    run = rf"[^{WS}]+(?:[{WS}]+[^{WS}]+){{0,{window - 1}}}"
    found = F.regexp_extract_all(t, F.lit(run), 0)
    return F.transform(found, lambda x: F.regexp_replace(x, f"[{WS}]+", " "))


def truncate255(c) -> Column:
    return F.substring(col(c), 1, 255)


def topics_from_logits(logits, labels: Sequence[str] = K.CLASSIFIER_TOPICS,
                       fallback: str = K.FALLBACK_TOPIC, threshold: float = 0.5) -> Column:
    """sigmoid(logit) > threshold -> label, in label order; none -> [fallback]; joined by ','."""
    lab = _lit_array(list(labels))
    pairs = F.arrays_zip(lab.alias("label"), F.slice(col(logits), 1, len(labels)).alias("logit"))
    kept = F.transform(
        F.filter(pairs, lambda p: (F.lit(1.0) / (F.lit(1.0) + F.exp(-p["logit"].cast("double")))) > threshold),
        lambda p: p["label"])
    return F.array_join(F.when(F.size(kept) > 0, kept).otherwise(F.array(F.lit(fallback))), ",")


def softmax(logits) -> Column:
    x = F.transform(col(logits), lambda v: v.cast("double"))
    m = F.array_max(x)
    e = F.transform(x, lambda v: F.exp(v - m))
    s = F.aggregate(e, F.lit(0.0), lambda a, v: a + v)
    return F.transform(e, lambda v: v / s)


def argmax(values) -> Column:
    """0-based index of the first maximum."""
    v = col(values)
    return (F.array_position(v, F.array_max(v)) - 1).cast("int")


# --- a tiny lexicon scorer (ours): logits from keyword hits ---------------------------
# Used as the default, SQL-checkable scorer on the multilingual test prose; real
# deployments inject a model scorer (see operators.labels.model_scorer).
TOPIC_LEXICON = {
    "가성비": ("price", "prix", "preis", "precio", "cheap", "value"),
    "내구성 및 품질": ("quality", "qualité", "durable", "the"),
    "디자인": ("design", "color", "la", "die"),
    "배송 및 포장 및 응대": ("delivery", "shipping", "livraison", "of"),
    "사이즈": ("size", "taille", "fit", "de"),
    "착용감": ("comfort", "comfortable", "confort", "and"),
}
POSITIVE_WORDS = ("good", "great", "bon", "gut", "bueno", "with", "et", "und", "y")
NEGATIVE_WORDS = ("bad", "poor", "mauvais", "schlecht", "malo", "not", "is", "que", "el")


def lexicon_logits(text, groups: Sequence[Sequence[str]], base: Sequence[float]) -> Column:
    """``base[i]`` + number of tokens of ``text`` found in ``groups[i]``, as one
    array. One regex scan extracts every lexicon token; a single ``aggregate`` over
    the (few) matches adds them to their groups (a word may be in several)."""
    where: dict[str, list[int]] = {}
    for i, g in enumerate(groups):
        for w in g:
            where.setdefault(w.lower(), []).append(i)
    zero = F.array(*[F.lit(float(b)) for b in base])
    pat = token_pattern(list(where))
    if pat is None:
        return zero
    m = F.create_map(*[x for w, ix in sorted(where.items())
                       for x in (F.lit(w), F.array(*[F.lit(i) for i in ix]))])
    found = F.regexp_extract_all(F.lower(col(text)), F.lit(pat), 0)

    def add(acc, w):
        ix = m[w]
        return F.transform(acc, lambda c, j: c + (F.size(ix) - F.size(F.array_remove(ix, j))).cast("double"))
    return F.aggregate(found, zero, add)


def lexicon_topic_logits(text, lexicon: dict = TOPIC_LEXICON,
                         labels: Sequence[str] = K.CLASSIFIER_TOPICS) -> Column:
    """Per label: (lexicon hits - 0.5), so any hit means sigmoid > 0.5."""
    return lexicon_logits(text, [lexicon.get(l, ()) for l in labels], [-0.5] * len(labels))


def lexicon_sentiment_logits(text, positive: Sequence[str] = POSITIVE_WORDS,
                             negative: Sequence[str] = NEGATIVE_WORDS) -> Column:
    """[negative hits, 0.5, positive hits]."""
    return lexicon_logits(text, [negative, (), positive], [0.0, 0.5, 0.0])


def strip_ws(c) -> Column:
    """Python's ``str.strip()``: every Unicode whitespace char at both ends."""
    return F.btrim(col(c), F.lit(WS_CHARS))
