import sys

from graphtables.cli import main

sys.exit(main())
