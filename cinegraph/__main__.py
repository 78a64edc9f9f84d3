"""python -m cinegraph"""

import sys

from cinegraph.cli import main

sys.exit(main())
