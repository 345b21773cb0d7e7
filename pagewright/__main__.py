import sys

from pagewright.cli import main

sys.exit(main())
