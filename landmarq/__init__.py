"""Subset selection, its evaluation, and training-data preparation on Spark DataFrames."""

import os

# Read when NumPy loads; where it has been loaded before, ``blas.one_thread`` sets the same.
for _name in ("OPENBLAS_NUM_THREADS", "OMP_NUM_THREADS", "MKL_NUM_THREADS"):
    os.environ.setdefault(_name, "1")
