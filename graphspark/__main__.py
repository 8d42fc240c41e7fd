import sys

from graphspark.cli import main

sys.exit(main())
