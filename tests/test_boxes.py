import random

from vitalforms.operators.boxes import field_boxes, word_regions

PAGE = "page_id long, form_type string, w int, h int, left int, top int, right int, bottom int"
WORD = "page_id long, word_no long, text string, x1 int, y1 int, x2 int, y2 int"
REGION = "form_type string, field string, rx1 double, ry1 double, rx2 double, ry2 double"


def test_grid_equals_all_boxes(spark):
    rng = random.Random(1)
    regions = [(f, f"r{i}", *sorted(rng.random() for _ in range(2))[:1], *[rng.random() for _ in range(3)]) for f in "ab" for i in range(20)]
    regions += [("a", "whole", 0.0, 0.0, 1.0, 1.0), ("b", "edge", 0.5, 0.25, 0.75, 0.5), ("b", "inverted", 0.8, 0.1, 0.6, 0.2)]
    pages = []
    for i in range(60):
        left, top = rng.randint(-40, 40), rng.randint(-40, 40)
        pages.append((i, rng.choice("aabbc"), rng.choice((9, 90, 400, 400)), rng.choice((9, 90, 400, 400)), left, top,
                      left + rng.choice((-20, 0, 15, 16, 100, 333, 333, 350)), top + rng.choice((-3, 31, 32, 250, 333, 400, 400))))
    words = [(rng.randrange(61), k, "t", x, y, x + rng.randint(0, 9), y + rng.randint(0, 9))
             for k in range(4000) for x, y in [(rng.randint(-20, 320), rng.randint(-20, 320))]]
    p, w, r = (spark.createDataFrame(rows, s) for rows, s in ((pages, PAGE), (words, WORD), (regions, REGION)))
    boxes = [tuple(b) for b in field_boxes(p, r).select("page_id", "field", "x1", "y1", "x2", "y2").collect()]
    want = sorted((g, k, "t", field) for g, k, _, x1, y1, x2, y2 in words for page, field, a, b, c, d in boxes
                  if page == g and a <= (x1 + x2) / 2 <= c and b <= (y1 + y2) / 2 <= d)
    found = word_regions(w, p, r)
    assert sorted(map(tuple, found.collect())) == want and len(want) > 100
    plan = found._jdf.queryExecution().optimizedPlan().toString()
    assert "collect_list" not in plan and word_regions(w.where("false"), p, r).count() == 0
