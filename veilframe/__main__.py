import sys

from veilframe.cli import main

sys.exit(main())
