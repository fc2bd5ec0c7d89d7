import sys

from traceloom.cli import main

sys.exit(main())
