from itertools import permutations

RULE_DV = "struct<type:string,op:string,f1:string,f2:string>"
RULE_CF = "struct<type:string,op:string,v1:string,v2:string>"
QUESTION = f"pair_id string, ord bigint, section string, number string, text string, row_num int, dv {RULE_DV}, cf {RULE_CF}"


def question(spark, rows):
    """Rows ``(pair_id, ord, text[, section, number, dv, cf])`` as a question table."""
    full = []
    for r in rows:
        pair, o, text, section, number, dv, cf = (*r, *([None] * (7 - len(r))))
        full.append((pair, o, section or "", number, text, o, dv, cf))
    return spark.createDataFrame(full, QUESTION)


def levenshtein(a, b):
    line = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        new = [i]
        for j, y in enumerate(b, 1):
            new.append(min(line[j] + 1, new[-1] + 1, line[j - 1] + (x != y)))
        line = new
    return line[-1]


def similarity(a, b):
    a, b = " ".join(a.split()).lower(), " ".join(b.split()).lower()
    if not a and not b:
        return 1.0
    if not a or not b:
        return 0.0
    return 1 - levenshtein(a, b) / max(len(a), len(b))


def best_total(weights):
    """Largest assignment total by trying every order."""
    rows, cols = len(weights), len(weights[0]) if weights else 0
    if rows > cols:
        weights = [list(c) for c in zip(*weights)]
        rows, cols = cols, rows
    return max(sum(weights[i][j] for i, j in enumerate(p)) for p in permutations(range(cols), rows)) if rows else 0.0
