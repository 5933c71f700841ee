import sys

from inkweave.cli import main

sys.exit(main())
