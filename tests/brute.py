"""Plain-Python metrics the Spark ones are compared with on small inputs."""
import math
import re
from collections import Counter


def bleu_words(text):
    for a, b in (("<skipped>", ""), ("-\n", ""), ("\n", " "), ("&quot;", '"'), ("&amp;", "&"), ("&lt;", "<"), ("&gt;", ">")):
        text = text.replace(a, b)
    text = f" {text} "
    for a, b in ((r"([\{-\~\[-\` -\&\(-\+\:-\@\/])", r" \1 "), (r"([^0-9])([\.,])", r"\1 \2 "),
                 (r"([\.,])([^0-9])", r" \1 \2"), (r"([0-9])(-)", r"\1 \2 ")):
        text = re.sub(a, b, text)
    return text.split()


def grams(words, n):
    return Counter(tuple(words[i:i + n]) for i in range(len(words) - n + 1))


def bleu(answer, reference, smooth="exp"):
    a, r = bleu_words(answer), bleu_words(reference)
    hits, totals = [], []
    for n in range(1, 5):
        ga, gr = grams(a, n), grams(r, n)
        hits.append(sum((ga & gr).values()))
        totals.append(sum(ga.values()))
    if not any(hits):
        return 0.0
    logs, used, zeros = 0.0, 0, 0
    for n in range(4):
        h, t = hits[n], totals[n]
        if smooth == "add-k" and n:
            h, t = h + 1, t + 1
        if t == 0:
            break
        used += 1
        if h == 0:
            zeros += 1
            p = {"exp": 100 / (2 ** zeros * t), "floor": 10 / t}.get(smooth, 0)
        else:
            p = 100 * h / t
        logs += math.log(p) if p else -9999999999
    bp = 1.0 if len(a) >= len(r) else math.exp(1 - len(r) / len(a))
    return bp * math.exp(logs / used)


def lcs(a, b):
    row = [0] * (len(b) + 1)
    for x in a:
        old = row[:]
        for j, y in enumerate(b):
            row[j + 1] = old[j] + 1 if x == y else max(row[j], old[j + 1])
    return row[-1]


def f1(hits, a, r):
    return 2 * hits / (a + r) if hits else 0.0


def rouge_words(text):
    return re.findall("[a-z0-9]+", text.lower())


def meteor(a, r, alpha=0.9, beta=3.0, gamma=0.5):
    """a, r: word lists; the last unmatched equal words pair first."""
    left, pairs = list(enumerate(r)), []
    for i in range(len(a) - 1, -1, -1):
        for k in range(len(left) - 1, -1, -1):
            if left[k][1] == a[i]:
                pairs.append((i, left.pop(k)[0]))
                break
    pairs.sort()
    if not pairs:
        return 0.0
    chunks = 1 + sum(1 for x, y in zip(pairs, pairs[1:]) if not (y[0] == x[0] + 1 and y[1] == x[1] + 1))
    p, q = len(pairs) / len(a), len(pairs) / len(r)
    return p * q / (alpha * p + (1 - alpha) * q) * (1 - gamma * (chunks / len(pairs)) ** beta)
