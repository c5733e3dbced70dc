"""Kernels carry all they need: a worker that cannot import the library runs them."""

import pickle
import subprocess
import sys

from pyspark import cloudpickle

from corpusmap.llm import common, near_copies, near_dup

RUN = """import pickle, sys
f = pickle.load(sys.stdin.buffer)
f("a b c d e f")
assert not any(m.startswith("corpusmap") for m in sys.modules)"""


def test_no_kernel_imports_the_library(tmp_path):
    kernels = (
        lambda text: near_copies.key_of(near_copies.shingle_set(text, 5)),
        lambda text: near_dup.simhash(common.shingle_hashes(text.encode())),
    )
    for kernel in kernels:
        sent = cloudpickle.dumps(kernel)
        done = subprocess.run([sys.executable, "-c", RUN], input=sent, cwd=tmp_path, env={}, capture_output=True, timeout=60)
        assert done.returncode == 0, done.stderr.decode()
    assert pickle.loads(cloudpickle.dumps(near_copies.key_of))
