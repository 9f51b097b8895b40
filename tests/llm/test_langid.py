import numpy as np

from quillsieve.llm.langid import ByteCNN, held_out, identify, train


def test_gradients_match_differences():
    rng = np.random.default_rng(1)
    net = ByteCNN(3, widths=(2, 3), filters=4, window=20, seed=2)
    for p in net.parameters():
        p[...] = rng.normal(0, 0.5, p.shape)
    net.tables, net.bias, net.dense = [t.astype(np.float64) for t in net.tables], [b.astype(np.float64) for b in net.bias], net.dense.astype(np.float64)
    x, y = rng.integers(97, 102, (6, 20)).astype(np.uint8), rng.integers(0, 3, 6)
    grads, _ = net.step(x, y)
    for p, g in zip(net.parameters(), grads, strict=True):
        for i in rng.integers(0, p.size, 12):
            old = p.flat[i]
            p.flat[i] = old + 1e-5
            up = net.step(x, y)[1]
            p.flat[i] = old - 1e-5
            down = net.step(x, y)[1]
            p.flat[i] = old
            assert abs((up - down) / 2e-5 - g.flat[i]) < 1e-4


def test_fast_prediction_equals_plain():
    rng = np.random.default_rng(1)
    net = ByteCNN(3, window=40).ready()
    x = rng.integers(0, 256, (9, 40)).astype(np.uint8)
    pooled = [max_ + b for t, b, w in zip(net.tables, net.bias, net.widths, strict=True) for max_ in [sum(t[k][x[:, k : k + 41 - w]] for k in range(w)).max(axis=1)]]
    assert np.allclose(net.predict(x), net._head(np.concatenate(pooled, axis=1)), atol=1e-5)


def test_held_out_accuracy_and_odd_rows(spark):
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
    names, net = train(docs.where(~held_out()))
    odd = spark.createDataFrame([(1, None), (2, ""), (3, "123 !?"), (None, "une maison est là avec les autres " * 3000), (4, "été")], "doc_id long, text string")
    got = {r.doc_id: r for r in identify(odd, names, net).collect()}
    assert [got[k].lang_pred for k in (1, 2, 3)] == ["und"] * 3 and got[None].lang_pred in names and got[4].lang_pred in names
    test = docs.where(held_out()).select("doc_id", "lang", "text")
    right = test.join(identify(test, names, net), "doc_id").selectExpr("avg(cast(lang = lang_pred as int)) a", "min(score) s", "max(score) t").first()
    assert right.a > 0.93 and 0 <= right.s <= right.t <= 1
    assert identify(odd.limit(0), names, net).count() == 0
    assert train(odd.selectExpr("*", "text lang").limit(0)) == ([], None)
    assert {r.lang_pred for r in identify(odd, [], None).collect()} == {"und"}
