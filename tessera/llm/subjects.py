"""Subject areas of documents.

A lexicon (features of sentences with their probability in each subject, one per language) is learned from the hand
labels of a bounded sample: every sentence has a latent subject or none, restricted by the labels of its document, and
expectation-maximisation fills in which. Labelling functions then vote on every document and subject:

* `lexicon`: is a fifth of the sentences about it, counted both with the surely classified sentences alone and with all
  that might be; it abstains where the two answers differ;
* `leaning`: the likelier answer where the lexicon abstains, and no vote elsewhere;
* `section`: do sections name it in the words of its title and description, which the lexicon does not use;
* `source`, `address` (the letters of the document number): do hand labels of the sample name the subject there at twice
  its usual rate, or at half;
* `label`: the hand labels of the document itself.

A latent model learns how accurate each of them is: at first against the hand labels, then from how they agree over the
whole corpus; and documents get the subjects whose posterior probability is above one half.
"""

from __future__ import annotations

import pickle
import re
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessera.llm.bpe import spread
from tessera.llm.sentences import FUNCTION_WORDS, LANGUAGES, analysed, features, is_aside, language_marks, language_of, parts, pieces, sentences

LEAST_SHARE = 0.2
MOST_LABELLED = 8_000  # documents whose labels the lexicon is fitted to; a sample by hash of doc_id where there are more
SEEN_SENTENCES = 200_000  # looked-up sentences per worker
SENTENCES_AT_ONCE = 4096
SURE = 3.0  # a sentence is surely of a class that is e**SURE times as likely as the next
VOTES = ("lexicon", "leaning", "section", "source", "address", "label")
TOGETHER = ((0, 1), (2,), (3, 4), (5,))  # of the votes: lexicon and leaning, source and address depend on each other
_DIGITS = re.compile("[0-9]+")


@dataclass
class Seen:
    """What is known of a sentence: marks of its language, whether it is an aside, the subjects it names, and per language its class and its rival's (-1: none)."""

    marks: tuple[int, ...]
    aside: bool
    named: tuple[int, ...]
    classes: dict[str, tuple[int, int]] = field(default_factory=dict)


@dataclass
class Lexicon:
    """For each language: number of each feature, its weighted log P(feature | class) and log P(class); class 0 is `none`.

    words maps words of the subjects' titles and descriptions to the subject's index.
    """

    subjects: list[str]
    parts: dict[str, tuple[dict[str, int], np.ndarray, np.ndarray]]
    words: dict[str, int] = field(default_factory=dict)
    seen: dict[str, Seen | None] = field(default_factory=dict, repr=False)

    def classify(self, sentence_features: list[list[str]], lang: str) -> list[tuple[int, int]]:
        """The likeliest class of each sentence, and the next where it is not surely the first (else -1); none in a language without labels."""
        out = [(0, -1)] * len(sentence_features)
        if lang not in self.parts:
            return out
        number, logphi, logpi = self.parts[lang]
        rows = [[number[f] for f in fs if f in number] for fs in sentence_features]
        at = [i for i, r in enumerate(rows) if r]
        if not at:
            return out
        start = np.r_[0, np.cumsum([len(rows[i]) for i in at])[:-1]]
        score = np.add.reduceat(logphi[[x for i in at for x in rows[i]]], start, axis=0) + logpi
        best = score.argmax(axis=1)
        top = score[np.arange(len(at)), best]
        score[np.arange(len(at)), best] = -np.inf
        rival = np.where(top - score.max(axis=1) >= SURE, -1, score.argmax(axis=1))
        for i, b, r in zip(at, best.tolist(), rival.tolist()):
            out[i] = (b, r)
        return out

    def read(self, texts: list[str | None]) -> list[list[list[tuple[int, int, tuple[int, ...]]]]]:
        """For each text and paragraph the class, rival and named subjects of each sentence. Sentences that are alike but for their digits are looked up."""
        if len(self.seen) >= SEEN_SENTENCES:
            self.seen.clear()
        seen, new, words = self.seen, {}, self.words
        docs = []
        for text in texts:
            paras = [[_DIGITS.sub("0", s) for s in pieces(p)] for p in parts(text)] if text else []
            for p in paras:
                for s in p:
                    if s not in seen:
                        if (told := analysed(s)) is None:
                            seen[s] = None
                            continue
                        new[s], marks = told
                        seen[s] = Seen(marks, is_aside(s), tuple({words[f] for f in told[0] if f in words}))
            docs.append([k for p in paras if (k := [s for s in p if seen[s] is not None])])
        langs, wanted = [], {}
        for paras in docs:
            each = [s for p in paras for s in p]
            langs.append(lang := language_of(list(map(sum, zip(*[seen[s].marks for s in each])))) if paras else LANGUAGES[0])
            if lacking := [s for s in each if lang not in seen[s].classes]:
                wanted.setdefault(lang, {}).update(dict.fromkeys(lacking))
        for lang, some in wanted.items():
            for s in [s for s in some if seen[s].aside]:
                seen[s].classes[lang] = (0, -1)
            asked = [s for s in some if not seen[s].aside]
            for a in range(0, len(asked), SENTENCES_AT_ONCE):
                part = asked[a : a + SENTENCES_AT_ONCE]
                for s, c in zip(part, self.classify([new[s] if s in new else features(s) for s in part], lang)):
                    seen[s].classes[lang] = c
        return [[[(*seen[s].classes[lang], seen[s].named) for s in p] for p in paras] for paras, lang in zip(docs, langs)]


def naming_words(descriptions: dict[str, str], subjects: list[str]) -> dict[str, int]:
    """Words of the titles and descriptions of single subjects, with the subject's index; function words are left out."""
    of: dict[str, set[int]] = {}
    common = set().union(*FUNCTION_WORDS.values())
    for i, s in enumerate(subjects):
        for w in features(descriptions.get(s) or ""):
            if " " not in w and len(w) > 2 and w not in common:
                of.setdefault(w, set()).add(i)
    return {w: next(iter(x)) for w, x in of.items() if len(x) == 1}


def _fit_language(docs: list[tuple[list[list[str]], list[int]]], classes: int, doubt: float = 0.05, smooth: float = 3.0, rounds: int = 15):
    """Expectation-maximisation over sentences; docs holds the features of each sentence and the classes labelled."""
    number: dict[str, int] = {}
    rows, of = [], []
    for d, (sents, _) in enumerate(docs):
        for fs in sents:
            rows.append([number.setdefault(f, len(number)) for f in fs])
            of.append(d)
    n_rows, v = len(rows), len(number)
    flat = np.concatenate([np.asarray(r, np.int32) for r in rows])
    start = np.r_[0, np.cumsum([len(r) for r in rows])]
    row = np.repeat(np.arange(n_rows, dtype=np.int32), np.diff(start))
    of = np.array(of)
    allowed = np.zeros((len(docs), classes))
    for d, (_, labels) in enumerate(docs):
        allowed[d] = doubt / classes
        for k in labels:
            allowed[d, k] += (1 - doubt) * 0.6 / len(labels)
        allowed[d, 0] += (1 - doubt) * (0.4 if labels else 1.0)
    # A sentence starts in the labelled subject to which its most telling feature points, as far as it does.
    seen = np.unique(of[row].astype(np.int64) * v + flat)
    label = np.zeros((len(docs), classes))
    for d, (_, labels) in enumerate(docs):
        label[d, labels] = 1
    base = label.mean(axis=0)
    in_docs = np.bincount(seen % v, minlength=v).astype(float)
    with_label = np.stack([np.bincount(seen % v, weights=label[seen // v, k], minlength=v) for k in range(classes)], axis=1)
    telling = (with_label + 3 * base) / (in_docs[:, None] + 3)
    best = np.maximum.reduceat(telling[flat], start[:-1], axis=0) * (label[of] > 0)
    q = best**4
    q[:, 0] = np.maximum(1 - best.max(axis=1), 0.02)
    q /= q.sum(axis=1, keepdims=True)
    log_allowed = np.log(allowed)
    for _ in range(rounds):
        count = np.stack([np.bincount(flat, weights=q[row, k], minlength=v) for k in range(classes)], axis=1)
        n = q.sum(axis=0)
        about = (count[:, 1:].sum(axis=1) + 0.01) / (n[1:].sum() + 0.02)
        whole = (count.sum(axis=1) + 0.01) / (n.sum() + 0.02)
        phi = (count + smooth * about[:, None]) / (n + smooth)
        phi[:, 0] = (count[:, 0] + smooth * whole) / (n[0] + smooth)
        # A feature counts as far as it tells classes apart; turns of phrase that all of them share hardly do.
        share = phi / phi.sum(axis=1, keepdims=True)
        weight = 1 + (share * np.log(share)).sum(axis=1, keepdims=True) / np.log(classes)
        logphi = np.log(phi) * weight
        lg = np.empty((n_rows, classes))
        for a in range(0, n_rows, 20_000):  # in parts, for memory
            z = min(a + 20_000, n_rows)
            lg[a:z] = np.add.reduceat(logphi[flat[start[a] : start[z]]], start[a:z] - start[a], axis=0)
        lg += log_allowed[of]
        lg -= lg.max(axis=1, keepdims=True)
        q = np.exp(lg)
        q /= q.sum(axis=1, keepdims=True)
    return number, logphi.astype(np.float32), np.log((q.sum(axis=0) + 1) / (q.sum() + classes)).astype(np.float32)


def prepared(text: str | None) -> tuple[str, list[str]]:
    """Language and sentences of a text (every number as 0), those left out that name a subject only in passing or to deny it."""
    sents = [_DIGITS.sub("0", s) for s in sentences(text)]
    marks = np.array([language_marks(s) for s in sents]).sum(axis=0) if sents else None
    return language_of(marks) if sents else LANGUAGES[0], [s for s in sents if not is_aside(s)]


def fit_lexicon_on(sample: DataFrame, subjects: list[str], descriptions: dict[str, str] | None = None) -> Lexicon:
    """A lexicon from a bounded DataFrame of text and labels (unknown ones are ignored; an empty array means none), each language in a task of its own; only the fitted lexicon comes to the driver."""
    number = {s: i + 1 for i, s in enumerate(subjects)}

    def told(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            langs, sents = zip(*[prepared(t.as_py()) for t in b.column(0)]) if b.num_rows else ((), ())
            yield pa.RecordBatch.from_arrays([pa.array(langs, pa.string()), pa.array(sents, pa.list_(pa.string())), b.column(1)], names=["lang", "sentences", "labels"])

    def fit(key: tuple, t: pa.Table) -> pa.Table:
        docs = [([f for s in sents if (f := features(s))], sorted({number[y] for y in labels if y in number})) for sents, labels in zip(t["sentences"].to_pylist(), t["labels"].to_pylist())]
        docs = [d for d in docs if d[0]]
        lexicon = {key[0].as_py(): _fit_language(docs, len(subjects) + 1)} if docs else {}
        return pa.table({"part": pa.array([pickle.dumps(lexicon)], pa.binary())})

    by_language = sample.select("text", "labels").mapInArrow(told, "lang string, sentences array<string>, labels array<string>")
    # So many partitions that languages hardly share one; a number that is given is not coalesced.
    apart = by_language.repartition(16 * len(LANGUAGES), "lang")
    fitted: dict = {}
    for r in apart.groupBy("lang").applyInArrow(fit, "part binary").collect():  # a row per language
        fitted |= pickle.loads(r["part"])
    return Lexicon(subjects, fitted, naming_words(descriptions or {}, subjects))


def labelled_sample(docs: DataFrame, labels: DataFrame, most: int = MOST_LABELLED) -> DataFrame:
    """The columns of docs and the array of labels of at most `most` labelled documents."""
    per = labels.where("doc_id IS NOT NULL").groupBy("doc_id").agg(F.collect_set("subject").alias("labels"))  # nulls are left out
    chosen = per.orderBy(F.xxhash64("doc_id"), "doc_id").limit(most)
    return docs.join(chosen, "doc_id")


def sentence_counts(docs: DataFrame, lexicon: Lexicon, keep: list[str]) -> DataFrame:
    """doc_id, kept columns, n_sentences, n_sections, and for each subject (arrays in the order of lexicon.subjects) the sentences about it, those surely and those possibly so, and the sections (paragraphs) that name it."""
    k = len(lexicon.subjects) + 1
    shared = docs.sparkSession.sparkContext.broadcast(lexicon)  # as large as the bounded sample makes it
    arrays = ("about", "surely", "maybe", "naming")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        lex = shared.value
        for b in batches:
            for at in range(0, b.num_rows, 256):
                part = b.slice(at, 256)
                n, sections, out = [], [], {a: [] for a in arrays}
                for paras in lex.read(part.column(part.num_columns - 1).to_pylist()):
                    x = [s for p in paras for s in p]
                    best, rival = np.array([s[0] for s in x], int), np.array([s[1] for s in x], int)
                    about, surely = np.bincount(best, minlength=k), np.bincount(best[rival < 0], minlength=k)
                    n.append(len(x))
                    sections.append(len(paras))
                    out["about"].append(about[1:].tolist())
                    out["surely"].append(surely[1:].tolist())
                    out["maybe"].append((about + np.bincount(rival[rival >= 0], minlength=k))[1:].tolist())
                    named = [i for p in paras for i in {i for s in p for i in s[2]}]
                    out["naming"].append(np.bincount(np.array(named, int), minlength=k - 1).tolist())
                yield pa.RecordBatch.from_arrays([*part.columns[:-1], pa.array(n, pa.int32()), pa.array(sections, pa.int32()), *[pa.array(out[a], pa.list_(pa.int32())) for a in arrays]], names=["doc_id", *keep, "n_sentences", "n_sections", *arrays])

    kinds = dict(docs.dtypes)
    rows = spread(docs.select("doc_id", *keep, "text"), "doc_id")
    return rows.mapInArrow(run, ", ".join(f"`{c}` {kinds[c]}" for c in ("doc_id", *keep)) + ", n_sentences int, n_sections int, " + ", ".join(f"{a} array<int>" for a in arrays))


def fit_label_model(patterns: list[tuple[tuple[int, ...], int]], together: tuple[tuple[int, ...], ...] | None = None, label: int | None = None, soft: int = 100, rounds: int = 200) -> dict[tuple[int, ...], float]:
    """Posterior probability of each pattern of votes (subject number first, then 1, -1 or 0 for each function).

    Classes of a subject have a prior of their own; the chances of votes given the truth are shared by all subjects.
    together groups functions whose votes depend on each other and so count as one with as many outcomes as they have
    combinations (default: each alone). All start as somewhat better than chance, or, where label is the number of the
    function of hand labels, at the accuracy they have against these; expectation-maximisation does the rest. After the
    soft rounds every pair counts wholly as what it is likelier to be: else the doubt about single pairs, which weak
    functions leave everywhere, would count as errors of the strong ones.
    """
    if not patterns:
        return {}
    votes = np.array([p for p, _ in patterns])
    n = np.array([c for _, c in patterns], float)
    subject, votes = votes[:, 0], votes[:, 1:]
    together = together or tuple((j,) for j in range(votes.shape[1]))
    outcome = [sum((votes[:, j] + 1) * 3**i for i, j in enumerate(g)) for g in together]
    # theta[g][y, v]: chance that the functions of group g vote v given truth y; one tells y by the sum of its votes at first
    lean = [np.sign(sum(np.arange(3 ** len(g)) // 3**i % 3 - 1 for i in range(len(g)))) for g in together]
    theta = [np.stack([np.choose(x + 1, ps) for ps in ((0.55, 0.30, 0.15), (0.15, 0.30, 0.55))]) for x in lean]
    if label is not None and (votes[:, label] > 0).any():
        for g, group in enumerate(together):
            for y, v in ((0, -1), (1, 1)):
                if label not in group:
                    theta[g][y] = np.bincount(outcome[g], weights=n * (votes[:, label] == v), minlength=3 ** len(group)) + 1.0
    theta = [t / t.sum(axis=1, keepdims=True) for t in theta]
    prior = np.full(subject.max() + 1, 0.1)
    q = np.zeros(len(n))
    for done in range(rounds):
        lg = [np.log(np.where(y, prior[subject], 1 - prior[subject])) + sum(np.log(t[y, o]) for t, o in zip(theta, outcome)) for y in (0, 1)]
        new = 1 / (1 + np.exp(np.clip(lg[0] - lg[1], -500, 500)))
        moved, q = np.abs(new - q).max(), new
        now = q if done < soft else (q > 0.5).astype(float)
        for y, w in ((0, n * (1 - now)), (1, n * now)):
            for t, o in zip(theta, outcome):
                c = np.bincount(o, weights=w, minlength=t.shape[1]) + 1.0
                t[y] = c / c.sum()
        one = np.bincount(subject, weights=n * now, minlength=len(prior))
        prior = (one + 1) / (np.bincount(subject, weights=n, minlength=len(prior)) + 10)
        if moved < 1e-6 and done > soft:
            break
    return {tuple(map(int, p)): float(x) for (p, _), x in zip(patterns, q)}


def lifts(sample: DataFrame, by: str, subjects: list[str]) -> list[tuple[str, int, int]]:
    """For values of a column of the labelled sample and subject numbers, 1 if labels name the subject there at twice its usual rate, -1 at half.

    As many rows at most as the sample has documents, times the subjects.
    """
    rows = sample.groupBy(by).agg(F.count(F.lit(1)).alias("docs"), *[F.sum(F.array_contains("labels", x).cast("int")).alias(f"n{i}") for i, x in enumerate(subjects)]).collect()
    total = max(1, sum(r["docs"] for r in rows))
    out = []
    for i in range(len(subjects)):
        usual = sum(r[f"n{i}"] for r in rows) / total
        for r in rows:
            near = (r[f"n{i}"] + 10 * usual) / (r["docs"] + 10)
            vote = 1 if near >= 2 * usual else -1 if near <= usual / 2 else 0
            if r[by] is not None and usual > 0 and vote:
                out.append((r[by], i, vote))
    return out


def subject_votes(counts: DataFrame, labels: DataFrame, subjects: list[str], told: dict[str, list[tuple[str, int, int]]] | None = None, least_share: float = LEAST_SHARE) -> DataFrame:
    """doc_id, subject_no and the vote of each labelling function, for documents with sentences. told: lifts of `source` and `address`."""
    known = F.array_position(F.array(*map(F.lit, subjects)), F.col("subject")) - 1
    per = labels.where("doc_id IS NOT NULL").groupBy("doc_id").agg(F.collect_set(known.cast("int")).alias("labelled"))
    each = F.arrays_zip(*map(F.col, ("about", "surely", "maybe", "naming")))
    named_any = F.exists("naming", lambda x: x > 0)
    rows = counts.where("n_sentences > 0").join(per, "doc_id", "left").select("doc_id", "source", "address", "n_sentences", "n_sections", "labelled", named_any.alias("named_any"), F.posexplode(each).alias("subject_no", "x"))
    share = lambda c, of: F.col(c) >= F.lit(least_share) * F.col(of) - 1e-9
    sure_yes, sure_no = share("x.surely", "n_sentences"), ~share("x.maybe", "n_sentences")
    votes = {
        "lexicon": F.when(sure_yes, 1).when(sure_no, -1).otherwise(0),
        "leaning": F.when(sure_yes | sure_no, 0).when(share("x.about", "n_sentences"), 1).otherwise(-1),
        "section": F.when((F.col("x.naming") > 0) & share("x.naming", "n_sections"), 1).when(F.col("named_any") & (F.col("x.naming") == 0), -1).otherwise(0),
        "label": F.when(F.col("labelled").isNull(), 0).when(F.array_contains("labelled", F.col("subject_no")), 1).otherwise(-1),
    }
    rows = rows.select("doc_id", "source", "address", "subject_no", *[c.alias(k) for k, c in votes.items()], share("x.about", "n_sentences").alias("counted"))
    for by in ("source", "address"):
        lift = counts.sparkSession.createDataFrame((told or {}).get(by, []), f"{by} string, subject_no int, {by}_vote int")
        rows = rows.join(F.broadcast(lift), [by, "subject_no"], "left")  # bounded by the sample
    return rows.select("doc_id", "subject_no", "lexicon", "leaning", "section", F.coalesce("source_vote", F.lit(0)).alias("source"), F.coalesce("address_vote", F.lit(0)).alias("address"), "label", "counted")


def assign_subjects(docs: DataFrame, labels: DataFrame, subjects: list[str], most_labelled: int = MOST_LABELLED, least_share: float = LEAST_SHARE, descriptions: dict[str, str] | None = None, cut=lambda df: df) -> DataFrame:
    """doc_id, subject and posterior of every subject a document is about.

    docs has doc_id (unique), text, source and doc_number; labels has doc_id and subject (null: none). Null, empty and
    wordless texts have no subject, nor has any text where no label is given. Subjects in labels that are not in
    `subjects` are ignored, as are labels of unknown documents; repeated labels count once. descriptions gives the
    title and description of subjects in words. Other columns are ignored. cut stores what is read more than once.
    """
    votes, table = voted(docs, labels, subjects, most_labelled, least_share, descriptions, cut)
    return votes.join(F.broadcast(table.where("posterior > 0.5")), ["subject_no", *VOTES]).select("doc_id", "subject", "posterior")


def voted(docs: DataFrame, labels: DataFrame, subjects: list[str], most_labelled: int, least_share: float, descriptions: dict[str, str] | None, cut) -> tuple[DataFrame, DataFrame]:
    """The votes on every document and subject, and the posterior of every pattern of them (at most 729 for each subject)."""
    slim = docs.select("doc_id", F.col("source").cast("string").alias("source"), F.regexp_extract(F.coalesce("doc_number", F.lit("")), r"^\p{L}+", 0).alias("address"), "text")
    sample = cut(labelled_sample(slim, labels, most_labelled))  # bounded, and read three times
    lexicon = fit_lexicon_on(sample, subjects, descriptions)
    told = {by: lifts(sample, by, subjects) for by in ("source", "address")}
    counts = cut(sentence_counts(slim, lexicon, ["source", "address"]))
    votes = subject_votes(counts, labels, subjects, told, least_share)
    patterns = votes.groupBy("subject_no", *VOTES).agg(F.count(F.lit(1)).alias("n")).collect()  # at most 729 for each subject
    posterior = fit_label_model([(tuple(r[c] for c in ("subject_no", *VOTES)), r["n"]) for r in patterns], TOGETHER, VOTES.index("label"))
    rows = [(*p, subjects[p[0]], x) for p, x in posterior.items()]
    return votes, docs.sparkSession.createDataFrame(rows, "subject_no int, " + ", ".join(f"{v} int" for v in VOTES) + ", subject string, posterior double")
