"""Compare all queries of the given plan modules: python tools/by_module.py 0.01 metric_queries …"""
import os
import sys

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))
import compare  # noqa: E402

from insolvia.plans import registry  # noqa: E402

sf, wanted = sys.argv[1], tuple(sys.argv[2:])
sys.argv = ["compare", sf] + [n for n, f in registry.QUERIES.items() if f.__module__.endswith(wanted)]
compare.main()
