from lanespan.operators import align as A


def test_alignment_by_layer(spark):
    def capture(passes, second):
        rows, t = [], 0
        for p in range(passes):
            for layer in range(2):
                for n in ("anchor<1>", "gemm<a>(x)", second if layer else "void gemm <b>", *(["extra"] * (p == 0))):
                    rows.append((0, t, t + 5 + layer, n))
                    t += 10
        return spark.createDataFrame([*rows, (0, t, t + 1, "anchor<1>")], "device int, s long, e long, name string")

    rules = [("gemm", "GEMM")]
    a = A.layered(capture(2, "copy_a"), "anchor", 2, 1, rules).where("pass = 1")
    b = A.layered(capture(3, "gemm<z>"), "anchor", 2, 1, rules)
    pick = A.chosen_pass(a, b).collect()[0]
    assert pick["pass"] == 2
    b = b.where("pass = 2")
    got = {(r.layer, r.k): r.status for r in A.launches(a, b).collect()}
    assert got[0, 3] == "same_order_exact_name" and got[1, 3] == "same_order_mismatch" and len(got) == 6
    s = {r.layer: r for r in A.summary(a, b).collect()}
    assert (s[0].match_rate, s[0].jaccard) == (1, 1) and s[1].matched == 2 and s[1].jaccard == 0.5
