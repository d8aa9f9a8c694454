"""ravel: build and judge reasoning datasets with Spark DataFrames.

Every operator is either ``Column -> Column`` (``ravel.functions``) or
``DataFrame -> DataFrame`` (``ravel.operators``); composite jobs live in
``ravel.plans``, readers/writers in ``ravel.sources`` and streaming
trackers in ``ravel.streaming``.
"""

__version__ = "0.1.0"
