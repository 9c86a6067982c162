"""Images of items against the rule spelled out, for odd ids and paths; no candidate rows are made."""

from tastebud.operators.clean import resolve_image_path

IDS = ["1", "12", "123", "1234", "1234567890", "12345678901", "a/b", "ab.jpg", "é", "0000000007", "7", "x", "", None, "12"]


def path(i, ext):
    return f"images/{i[:3]}/{i}{ext}"


def test_images_by_the_rule(spark):
    ids = [i for i in IDS if i is not None]
    files = [path(i, e) for n, i in enumerate(ids) for e in (".jpg", ".png") if (n + len(e + i)) % 3 or e == ".png" and n % 2]
    files += [path(i.rjust(10, "0"), ".png") for i in ids[::2]] + [path(i.rjust(10, "0"), ".jpg") for i in ids[::4]]
    files += ["images/12/124.jpg", "images/123/1234.gif", "other/123/1234.jpg", "images//", "x", "", ".jpg", "images/1/1.JPG", None] + files[:3]
    want = []
    for i in IDS:
        forms = [] if i is None else [path(f, e) for f in (i, i if len(i) >= 10 else i.rjust(10, "0")) for e in (".jpg", ".png")]
        want.append((i, "n", next((f for f in forms if f in files), None)))
    items = spark.createDataFrame([(i, "n") for i in IDS], "article_id string, prod_name string")
    out = resolve_image_path(items, spark.createDataFrame([(f,) for f in files], "path string"))
    assert out.columns == ["article_id", "prod_name", "image_path"]
    assert sorted(map(str, map(tuple, out.collect()))) == sorted(map(str, want))
    assert "Generate" not in out._jdf.queryExecution().toString()
