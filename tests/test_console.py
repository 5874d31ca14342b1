import pytest

from pairloom.__main__ import main
from pairloom.sources import text


@pytest.mark.parametrize("kind, body, flags, want", [
    ("general", "5 7\n0 1\n1 2\n2 0\n2 3\n3 4\n4 4\n1 9\n", ["--greedy"], ["Graph: 5 vertices, 5 edges", "Greedy init size: 2", "Greedy/Final: 100.00%", "Matching size: 2", "Matched vertices: 4"]),
    ("general", "4 3\n0 1\n0 2\n1 3\n", ["--greedy", "--strategy", "rounds"], ["Graph: 4 vertices, 3 edges", "Greedy init size: 1", "Greedy/Final: 50.00%", "Matching size: 2", "Matched vertices: 4"]),
    ("bipartite", "3 3 5\n0 0\n0 1\n1 1\n1 2\n2 2\n", ["--kind", "bipartite", "--strategy", "rounds"], ["Graph: 3 left, 3 right, 5 edges", "Matching size: 3", "Matched vertices: 6"]),
    ("mtx", "%%MatrixMarket\n4 4 3\n1 2 1\n2 1 1\n3 4 1\n", ["--kind", "mtx", "--greedy-md"], ["Graph: 4 vertices, 2 edges", "Greedy init size: 2", "Greedy/Final: 100.00%", "Matching size: 2", "Matched vertices: 4"]),
    ("general", "3 0\n", ["--greedy"], ["Graph: 3 vertices, 0 edges", "Greedy init size: 0", "Greedy/Final: 100.00%", "Matching size: 0", "Matched vertices: 0"]),
])
def test_command_line(spark, tmp_path, capsys, kind, body, flags, want):
    (tmp_path / "g.txt").write_text(body)
    assert main([str(tmp_path / "g.txt"), *flags], spark) == 0
    lines = capsys.readouterr().out.strip().split("\n")
    assert lines[:-2] == want and lines[-2] == "VALIDATION PASSED" and lines[-1].startswith("Time: ")
    log = text.parse_logs(spark.createDataFrame([("\n".join(lines),)], "value string")).first()
    assert (log["size"], log["validation"]) == (int(want[-2].split()[-1]), "PASS") and log["time_ms"] >= 0


def test_wrong_arguments(spark, tmp_path):
    with pytest.raises(SystemExit):
        main(["x", "--greedy", "--greedy-md"], spark)
    (tmp_path / "g.txt").write_text("1 2 3\n")
    with pytest.raises(ValueError):
        main([str(tmp_path / "g.txt")], spark)
