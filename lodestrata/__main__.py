import sys

from lodestrata.commands import main

sys.exit(main())
