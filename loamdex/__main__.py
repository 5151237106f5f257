import sys

from loamdex.serve.cli import main

sys.exit(main())
