"""Command lines and the streaming refresh, end to end on small files."""

import random

from recospark import schemas
from recospark.jobs import build, recommend
from recospark.streaming import profiles


def inputs(top):
    rng = random.Random(3)
    ratings = [(u, i, rng.choice([1.0, 3.0, 4.0, 5.0]), rng.randint(0, 999)) for u in range(1, 21) for i in rng.sample(range(1, 13), 9)]
    (top / "ratings.csv").write_text("userId,movieId,rating,timestamp\n" + "".join(f"{','.join(map(str, r))}\n" for r in ratings))
    (top / "movies.csv").write_text("movieId,title,genres\n" + "".join(f'{i},"Film {i}, The (19{70 + i})",A|B{i % 3}\n' for i in range(1, 13)))
    (top / "tags.csv").write_text("userId,movieId,tag,timestamp\n" + "".join(f"{i},{i},tag {i % 4},1\n" for i in range(1, 13)))
    (top / "links.csv").write_text("movieId,imdbId,tmdbId\n1,5,6\n1,7,8\n")
    return [a for k in ("ratings", "movies", "tags", "links") for a in (f"--{k}", f"{top}/{k}.csv")]


def test_build_and_recommend(spark, tmp_path, capsys):
    args = inputs(tmp_path)
    for job, more in (("item-index", []), ("profiles", []), ("item-similarity", ["--set", "min_cooccurrence=2"]), ("user-similarity", ["--set", "top_k=5"])):
        assert build.main([job, *args, "--output", f"{tmp_path}/{job}", *more]) == 0
    items = spark.read.schema(schemas.ITEM_INDEX).json(f"{tmp_path}/item-index")
    assert items.count() == 12 and items.filter("item_id = 1").first().ext.imdb_id == "tt0000007"
    recommend.main([*(a for k, v in (("profiles", "profiles"), ("items", "item-index"), ("item-similarity", "item-similarity"), ("user-similarity", "user-similarity")) for a in (f"--{k}", f"{tmp_path}/{v}")), "--user-id", "1", "--user-id", "99", "--max-results", "3"])
    said = capsys.readouterr().out.splitlines()
    assert said[0] == "1 SUCCESS" and said[1] == "99 USER_NOT_FOUND" and 1 <= len(said) - 2 <= 3
    build.main(["item-similarity", *args, "--output", "-", "--sink", "count"])
    assert len(capsys.readouterr().out.split()) == 2


def test_stream(spark, tmp_path):
    inputs(tmp_path)
    (tmp_path / "in").mkdir()
    movies, tags = (spark.read.csv(f"{tmp_path}/{k}.csv", header=True, schema=s) for k, s in (("movies", schemas.MOVIES), ("tags", schemas.TAGS)))

    def run(rows, name):
        spark.createDataFrame(rows, schemas.RATINGS).coalesce(1).write.mode("append").parquet(f"{tmp_path}/in")
        query = profiles.start(spark.readStream.schema(schemas.RATINGS).parquet(f"{tmp_path}/in"), f"{tmp_path}/store", f"{tmp_path}/out", movies, tags, f"{tmp_path}/cp")
        query.processAllAvailable()
        query.stop()
        return {r.user_id: r.stats.rating_count for r in spark.read.parquet(f"{tmp_path}/out/batch={name}").collect()}

    assert run([(1, 1, 5.0, 10), (2, 1, 4.0, 10)], 0) == {1: 1, 2: 1}
    assert run([(1, 2, 3.0, 20)], 1) == {1: 2}


def test_build_and_write_apart(spark, tmp_path, capsys):
    import pytest

    args = inputs(tmp_path)
    between = ["--documents", f"{tmp_path}/between"]
    assert build.main(["item-similarity", *args, *between, "--skip-write"]) == 0
    assert build.main(["item-similarity", *between, "--skip-build", "--output", "-", "--sink", "count"]) == 0
    build.main(["item-similarity", *args, "--output", "-", "--sink", "count"])
    one, other = capsys.readouterr().out.splitlines()
    assert one == other
    for bad in (["--skip-build", "--output", "x"], [*between, "--skip-build", "--skip-write"], []):
        with pytest.raises(SystemExit):
            build.main(["item-similarity", *bad])
