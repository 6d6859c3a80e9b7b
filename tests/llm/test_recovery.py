"""Files and tables that outlive their makers."""

import numpy as np
import pyarrow.fs as pafs
import pytest

from gridspark.llm import common, token_files


def test_a_file_appears_whole_or_not_at_all(tmp_path):
    fs = pafs.LocalFileSystem()
    writer = token_files.SequenceWriter(fs, str(tmp_path / "a.arrow"), np.uint16, 8, 2)
    writer.add(1, np.arange(20, dtype=np.uint16))
    assert not (tmp_path / "a.arrow").exists()
    again = token_files.SequenceWriter(fs, str(tmp_path / "a.arrow"), np.uint16, 8, 2)
    again.add(1, np.arange(20, dtype=np.uint16))
    import pyarrow as pa

    again.close(pa.int64())
    writer.close(pa.int64())  # a second attempt at the same task replaces the file by its like
    assert token_files.SequenceFile(fs, str(tmp_path / "a.arrow")).tokens(3, 9).tolist() == list(range(3, 12))
    assert not list(tmp_path.glob("*.tmp*"))


def test_scratch_tables_lie_in_the_shared_folder(spark):
    df = common.materialise(spark.range(5), "t")
    assert df._scratch_path.startswith(common.shared_dir(spark)) and df.count() == 5
    common.discard(df)
    with pytest.raises(Exception):
        spark.read.parquet(df._scratch_path).count()
