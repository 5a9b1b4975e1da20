"""Pages in the form of the documents table."""

SCHEMA = "doc_id bigint, text string, n_cols int, boxes array<struct<x0:int,y0:int,x1:int,y1:int,conf:int>>, source string, lang string, x0 string"
PITCH = {1: 2230, 2: 1130, 3: 763}
INSET = {"body": 3, "head": 22, "advert": 64}


def page(doc_id, columns, source=None, lang=None, merged=None, shuffle=None):
    """columns: lists of (kind, line) or lines of body text."""
    n = len(columns)
    cells = []
    for c, column in enumerate(columns):
        for k, cell in enumerate(column):
            kind, line = cell if isinstance(cell, tuple) else ("body", cell)
            x0, y0 = 120 + c * PITCH[n] + INSET[kind], 264 + 36 * k
            cells.append((line, (x0, y0, x0 + 18 * len(line), y0 + 32, 90), k))
    if merged:
        rows = max(len(c) for c in columns)
        out = []
        for k in range(rows):
            own = [x for x in cells if x[2] == k]
            boxes = [b for _, b, _ in own]
            out.append((merged.join(line for line, _, _ in own), (boxes[0][0], boxes[0][1], boxes[-1][2], boxes[0][3], 90), k))
        cells = out
    if shuffle:
        shuffle(cells)
    return (doc_id, "\n".join(line for line, _, _ in cells), n, [b for _, b, _ in cells], source, lang, "clash")


def rows(spark, pages):
    return spark.createDataFrame(pages, SCHEMA)
