"""Numpy kernels on whole signals, run inside Arrow and pandas functions (see ``functions.udf``)."""
