import os
import sys

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))
sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))

#: As in the folder above: a run of all tests may find this module under the same name.
SF = "/root/testdata/sf0.001"
